"""Plain versions of the operators, over lists of dicts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@lru_cache(maxsize=1)
def tokenizer() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encode(text: str | None) -> list[int]:
    return tokenizer().encode(text or "", add_special_tokens=False).ids


class Sets:
    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def op1(docs: list[dict], end_id: int = 2) -> list[dict]:
    out, start = [], 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = encode(d["text"]) + [end_id]
        out.append({"doc_id": d["doc_id"], "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())})
        start += len(ids)
    return out


def op2(rows: list[dict], threshold: float = 0.93) -> list[dict]:
    def good(r):
        v = r["embedding"]
        return r["label"] is not None and v and None not in v and np.isfinite(v).all() and any(v)

    links, sets = Counter(), Sets()
    kinds = defaultdict(list)
    for k, r in enumerate(rows):
        sets.root((r["vec_id"], k))
        if good(r):
            kinds[r["label"], len(r["embedding"])].append(k)
    for some in kinds.values():
        x = np.array([rows[k]["embedding"] for k in some], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            a, b = some[i], some[j]
            links[a] += 1
            links[b] += 1
            sets.join((rows[a]["vec_id"], a), (rows[b]["vec_id"], b))
    return [{"vec_id": r["vec_id"], "n_links": links[k], "component_id": sets.root((r["vec_id"], k))[0], "kept": sets.root((r["vec_id"], k))[0] == r["vec_id"]} for k, r in enumerate(rows)]


def size(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def op3_targets(docs: list[dict]) -> dict:
    """Target of each source, by bisection on the common rate."""
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += size(d["text"])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    low, high, total = 0.0, 2.0 * sum(sizes.values()) + 1, 1.5 * sum(sizes.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * weight[s]) for s in names) < total else (low, mid)
    return {s: (sizes[s], min(2 * sizes[s], high * weight[s])) for s in names}


def words4(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def op4(docs: list[dict], items: list[dict], n: int = 10) -> list[dict]:
    owners = defaultdict(set)
    for it in items:
        w = words4(it["text"])
        if w and it["item_id"] is not None:
            for i in range(max(1, len(w) - n + 1)):
                owners[tuple(w[i : i + n])].add(str(it["item_id"]))
    lengths = {len(k) for k in owners}
    out = []
    for d in docs:
        w, hit, found = words4(d["text"]), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in owners:
                    hit.update(range(i, i + k))
                    found |= owners[tuple(w[i : i + k])]
        out.append({"doc_id": d["doc_id"], "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": sha(",".join(sorted(found))), "contaminated": bool(hit)})
    return out


def op6(rows: list[dict]) -> list[dict]:
    talks = defaultdict(list)
    for r in rows:
        talks[r["conv_id"]].append(r)
    out = []
    for conv, turns in talks.items():
        turns.sort(key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
        loss = "".join(r["text"] or "" for r in turns if r["role"] == "assistant")
        out.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": sha("".join(f"{r['role'] or ''}\n{r['text'] or ''}\n" for r in turns)), "loss_chars": len(loss), "loss_sha256": sha(loss)})
    return out


def shingle_set(text: str | None) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def op7(docs: list[dict], percent: int = 85) -> list[dict]:
    sets, by, owned = Sets(), defaultdict(set), [shingle_set(d["text"]) for d in docs]
    nodes = [(d["doc_id"], k) for k, d in enumerate(docs)]
    for k, s in enumerate(owned):
        sets.root(nodes[k])
        for x in s:
            by[x].add(k)
    for k, s in enumerate(owned):
        shared = Counter(o for x in s for o in by[x] if o < k)
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(owned[o]) - n):
                sets.join(nodes[k], nodes[o])
    least = [sets.root(n)[0] for n in nodes]
    return [{"doc_id": d["doc_id"], "n_shingles": len(s), "component_id": c, "kept": c == d["doc_id"]} for d, s, c in zip(docs, owned, least, strict=True)]


def op8(pages: list[dict], rules: list[tuple], default: str = "allow") -> list[dict]:
    out = []
    for p in pages:
        m = re.search(r"://([^/?#]*)([^?#]*)", p["url"] or "", re.DOTALL)
        host, path = (m[1].translate(ASCII_LOWER), m[2]) if m else ("", "")
        fits = [(len(h) + len(q), len(h), v == "block", h + q, v) for h, q, v in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        best = max(fits, default=None)
        out.append({"page_id": p["page_id"], "host": host, "path": path, "rule": best and best[3], "verdict": best[4] if best else default})
    return out


def op9(docs: list[dict], limit: int = 512) -> list[dict]:
    n = [len(encode(d["text"])) for d in docs]
    return [{"doc_id": d["doc_id"], "n_bytes": len((d["text"] or "").encode()), "n_tokens": k, "over_limit": k > limit} for d, k in zip(docs, n, strict=True)]


def key10(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)


def op10(docs: list[dict], least: int = 10) -> list[dict]:
    big = (1 << 63) - 1
    seen = defaultdict(set)
    for d in docs:
        for line in (d["text"] or "").split("\n"):
            seen[key10(line)].add(big if d["doc_id"] is None else d["doc_id"])
    out = []
    for d in docs:
        lines = (d["text"] or "").split("\n")
        own = big if d["doc_id"] is None else d["doc_id"]
        left = [x for x in lines if len(key10(x)) < least or len(seen[key10(x)]) < 2 or min(seen[key10(x)]) == own]
        out.append({"doc_id": d["doc_id"], "n_lines": len(lines), "n_dropped": len(lines) - len(left), "kept_sha256": sha("\n".join(left))})
    return out
