"""Allow and block rules on urls, looked up in a sorted array of digests (operator 8).

A rule is a host with a path prefix. Rules are kept as files in the shared folder: sorted 64-bit xxhash digests, offsets, and
the rules' full strings. Workers map the files. For each url the suffixes of its host at dots (only as
deep as some rule goes) with the prefixes of its path (only of lengths that some rule has) are hashed, all of a batch are probed
by one binary search, and a hit counts if the stored string is equal. The rule with the longest string wins, of
equally long ones that with the longer host.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end.

Definitions: a null url and one without ``://`` have empty host and path and fit no rule. Urls that fit none get
``default``. Rules with a null or empty host are left out, a null path is empty; if one rule has both verdicts, block holds. Rows
are kept as they are. Empty tables are allowed on either side. Urls of any length are judged whole. Other columns, whatever their names, are
not read.

Scale: pages are one pass without exchange. Rules are range-partitioned by digest into files of
``RULES_PER_FILE``; distinct path lengths and host depths are the only things that reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm import shared

RULES_PER_FILE = 4_000_000
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def key(host: str, path: str) -> str:
    return f"{host}\n{path}"


class Rules:
    """Mapped rule files."""

    def __init__(self, folder: str):
        self.parts = []
        for name in sorted(f.base_name for f in shared.listed(folder) if f.base_name.endswith(".keys")):
            files = [shared.mapped(f"{folder}/{name.removesuffix('keys')}{kind}") for kind in ("keys", "offsets", "strings")]
            self.parts.append((np.frombuffer(files[0], "<u8"), np.frombuffer(files[1], "<i8"), files[2]))
        self.firsts = np.array([p[0][0] for p in self.parts], "<u8")

    def find(self, digests: np.ndarray, keys: list[str]) -> list[str | None]:
        """Verdict of each key that is a rule."""
        out: list[str | None] = [None] * len(keys)
        file = np.searchsorted(self.firsts, digests, side="right") - 1
        for f, (have, offsets, strings) in enumerate(self.parts):
            mine = np.flatnonzero(file == f)
            place = np.searchsorted(have, digests[mine])
            place = np.minimum(place, len(have) - 1)
            for i, p in zip(mine[have[place] == digests[mine]].tolist(), place[have[place] == digests[mine]].tolist(), strict=True):
                while p < len(have) and have[p] == digests[i]:
                    verdict, _, string = strings[offsets[p] : offsets[p + 1]].to_pybytes().decode("utf-8", "surrogatepass").partition("\n")
                    if string == keys[i]:
                        out[i] = verdict
                        break
                    p += 1
        return out


def write_rules(rules: DataFrame, folder: str) -> tuple[list[int], list[int]]:
    """Write rule files from (host, path, verdict); returns the path lengths and host depths in use."""
    shared.make_folder(folder)
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = rules.select(lower.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' is the greater

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [xxhash.xxh64_intdigest(key(r["host"], r["path"]).encode("utf-8", "surrogatepass")) for r in b.to_pylist()]
            # ordered as unsigned by turning the top bit
            yield pa.RecordBatch.from_arrays([pa.array((np.array(h, np.uint64) ^ np.uint64(1 << 63)).view(np.int64)), *b.columns], names=["digest", "host", "path", "verdict"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        name = f"{folder}/{TaskContext.get().partitionId():06d}"
        keys = table["digest"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        strings = [f"{r['verdict']}\n{key(r['host'], r['path'])}".encode("utf-8", "surrogatepass") for r in table.to_pylist()]
        for kind, content in (("strings", b"".join(strings)), ("offsets", np.cumsum([0, *map(len, strings)]).astype("<i8").tobytes()), ("keys", keys.astype("<u8").tobytes())):
            out = shared.AtomicFile(f"{name}.{kind}")
            out.write(content)
            out.close()
        yield from ()

    digested = shared.stored(rules.mapInArrow(digest, "digest long, host string, path string, verdict string"), "rules")
    depth = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    facts = digested.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("lengths"), F.collect_set(depth).alias("depths")).first()
    ordered = digested.repartitionByRange(facts.n // RULES_PER_FILE + 1, "digest").sortWithinPartitions("digest")
    ordered.mapInArrow(write, "n int").write.format("noop").mode("overwrite").save()
    return sorted(facts.lengths), sorted(facts.depths)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that holds, or null), verdict of every row."""
    folder = shared.new_folder(pages.sparkSession, "url-rules")
    lengths, depths = write_rules(rules, folder)
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Rules(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                split = [split_url(u) for u in part.column(1).to_pylist()]
                owners, pairs = [], []
                for i, (host, path) in enumerate(split):
                    labels = host.split(".")
                    ends = [".".join(labels[-d - 1 :]) for d in depths if d < len(labels)]
                    some = [(h, path[:n]) for h in ends for n in lengths if n <= len(path)]
                    pairs += some
                    owners += [i] * len(some)
                keys = [key(h, p) for h, p in pairs]
                digests = np.fromiter((xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys), np.uint64, len(keys))
                best: list[tuple | None] = [None] * len(split)
                for i, (h, p), verdict in zip(owners, pairs, known.find(digests, keys), strict=True):
                    if verdict and (best[i] is None or (len(h) + len(p), len(h)) > best[i][0]):
                        best[i] = ((len(h) + len(p), len(h)), h + p, verdict)
                columns = [[h for h, _ in split], [p for _, p in split], [b and b[1] for b in best], [b[2] if b else default for b in best]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.string()) for c in columns)], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
