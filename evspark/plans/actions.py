"""Action plans for routed events and idle firings, and the ledger of both.

A routed event has the envelope columns, ``sensor_key`` and ``generation``. Keys can be hot, so
per-sensor facts (first event, first event of an idle check) are small aggregates that are
joined back; no window runs over all events of a sensor. Spark takes an aggregate for as large as its
input and would shuffle all events for it, so facts of generations are broadcast by a hint and wake-ups are stored. Where few rows decide these facts,
they are known before events are paired with sensors (:func:`run_knowledge`), and rows come with them: then nothing is looked up per pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.columns import ceil_div, micros, overlay_named
from evspark.functions.ordered import last_value
from evspark.functions.ranged import in_order
from evspark.operators.manifest import gvr, manifest
from evspark.operators.registry import ticks_between
from evspark.operators.state import RUN, fire_time
from evspark.session import as_table
from evspark.settings import DEFAULTS, Settings
from evspark.sources.envelope import IDENTITY, ORDER

# Resources without a namespace, kinds created through a typed client, scalable kinds.
CLUSTER_RESOURCES = ("namespaces", "nodes")
TYPED_KINDS = ("Pod", "Job")
SCALABLE_KINDS = ("StatefulSet", "Deployment")
DEFAULT_NAMESPACE = "default"
OPERATIONS = ("create", "delete", "scale")

ROW = [*IDENTITY, *RUN]
OBJECT = ["kind", "target_namespace", "name"]
LEDGER = [*ROW, "ts", "operation", "resource", "target_namespace", "name", "action", "outcome", "error"]


def sensor_objects(sensors: DataFrame) -> DataFrame:
    """Operation and decoded object of each sensor, narrow enough to be a lookup table."""
    return (
        sensors.select("sensor_key", F.col("actor.operation").alias("operation"), manifest(F.col("actor.manifest")).alias("o"))
        .select(
            "sensor_key", "operation", "o.kind", gvr(F.col("o.api_version"), F.col("o.kind"))["resource"].alias("resource"),
            F.col("o.namespace").alias("object_namespace"), "o.name", F.col("o.labels").alias("object_labels"),
            F.col("o.replicas").alias("template_replicas"), "o.containers",
        )
    )


def plan_actions(routed: DataFrame, sensors: DataFrame) -> DataFrame:
    """Routed events with their object, the planned action and the error of unknown operations.

    Rows that were routed with their objects (``routing.route_all(known=)``) do not look for them again.
    """
    op = F.col("operation")
    known = op.isin(*OPERATIONS)
    objects = sensor_objects(sensors)
    clashing = set(objects.columns) & set(routed.columns) - {"sensor_key"}
    met = routed if len(clashing) == len(objects.columns) - 1 else routed.drop(*clashing).join(objects, "sensor_key")
    return (
        met.withColumn("action", F.when(op == "scale", "scale_up").when(known, op).otherwise("none"))
        .withColumn("error", F.when(~known, F.lit("operation.not_known")))
    )


def _earliest(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events at the first time of their group, null being before all. They are few, so facts with strings, for which Spark sorts the rows
    that it gathers, are cheap to take from them; the time itself needs no sort.
    """
    at = F.coalesce(micros(F.col("ts")), F.lit(-(2**63)))
    first = events.groupBy(*keys).agg(F.min(at).alias("_at")).select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_at")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return events.join(F.broadcast(first), reduce(Column.__and__, [*same, at == F.col("_at")]), "left_semi")


def _namespace(first: str | Column) -> Column:
    """Namespace of the object, else that of the first event, else the default; none for cluster resources."""
    found = F.coalesce(F.nullif("object_namespace", F.lit("")), F.nullif(first, F.lit("")), F.lit(DEFAULT_NAMESPACE))
    return F.when(F.col("resource").isin(*CLUSTER_RESOURCES), "").otherwise(found)


def first_namespaces(events: DataFrame) -> DataFrame:
    """The namespace of the first event of each generation (``first_namespace``)."""
    return _earliest(events, RUN).groupBy(*RUN).agg(F.min_by("namespace", F.struct(*ORDER)).alias("first_namespace"))


def resolve_namespace(plan: DataFrame) -> DataFrame:
    """Add ``target_namespace``; the one found for the first event of a generation stays for all later ones.

    Rows that were routed with their ``first_namespace`` (``routing.route_facts``, :func:`namespace_knowledge`) are not gathered again.
    """
    told = plan if "first_namespace" in plan.columns else plan.join(F.broadcast(first_namespaces(plan)), RUN)
    return told.withColumn("target_namespace", _namespace("first_namespace")).drop("first_namespace")


def namespace_knowledge(few: DataFrame, sensors: DataFrame) -> tuple[DataFrame, None]:
    """Object and ``first_namespace`` of each generation, from the ``few`` rows that decide it, for ``routing.route_deciding(know=)``."""
    return as_table(sensor_objects(sensors).join(first_namespaces(few), "sensor_key")), None


def _event_labels(settings: Settings, uuid: Column) -> tuple[list[str], Column, Column]:
    """All names of labels that describe an event, and those of an event with their values; the uuid is left out when empty."""
    # Label names.
    pairs = {
        "pod-uuid": uuid,
        "action-timestamp": F.unix_millis("ts").cast("string"),
        "event-namespace": F.col("namespace"),
        "event-type": F.col("type"),
        "event-source": F.col("source"),
        "event-data": F.col("data"),
        "event-version": F.col("version"),
    }
    names, values = [settings.label(k) for k in pairs], [*pairs.values()]
    either = lambda full, rest: F.when(uuid != "", F.array(*full)).otherwise(F.array(*rest))
    texts = [F.lit(n) for n in names]
    return names, either(texts, texts[1:]), either(values, values[1:])


def event_dict(settings: Settings = DEFAULTS, uuid: Column | None = None) -> Column:
    """Labels describing an event; the uuid is left out when empty."""
    _, keys, values = _event_labels(settings, F.col("uuid") if uuid is None else uuid)
    return F.map_from_arrays(keys, values)


def merge_labels(plan: DataFrame, settings: Settings = DEFAULTS, slice_width: int | None = None, carried: DataFrame | None = None) -> DataFrame:
    """Add ``labels``: object labels overwritten by those of the event.

    Labels persist on the object, so an event without uuid keeps the last non-empty one. ``carried`` (generation, ``last_uuid``) is what
    earlier events have left behind. Rows that were routed with their ``last_uuid`` (``routing.route_facts``) are not put in order again.
    """
    if "last_uuid" in plan.columns:
        seen = plan.withColumn("_uuid", F.col("last_uuid"))
    else:
        seen = in_order(plan, RUN, ORDER, slice_width).scan(_uuid=last_value(F.nullif(F.col("uuid"), F.lit("")))).rows()
    uuid = F.col("_uuid")
    if carried is not None:
        seen, uuid = seen.join(F.broadcast(carried.select(*RUN, F.col("last_uuid").alias("_carried"))), RUN, "left"), F.coalesce("_uuid", "_carried")
    labels = overlay_named(F.col("object_labels"), *_event_labels(settings, F.coalesce(uuid, F.lit(""))))
    return seen.withColumn("labels", labels).select(*plan.columns, "labels")


def later_uuids(carried: DataFrame, plan: DataFrame) -> DataFrame:
    """The last non-empty uuid of each generation, after the events of ``plan``."""
    last = plan.where("uuid <> ''").groupBy(*RUN).agg(F.max_by("uuid", F.struct(*ORDER)).alias("_new"))
    return carried.join(last, RUN, "full").select(*RUN, F.coalesce("_new", "last_uuid").alias("last_uuid"))


def event_env(plan: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Event variables for each container of a Pod or Job, sorted by name."""
    env = F.transform(
        F.array_sort(F.map_entries(event_dict(settings))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))
    )
    return (
        plan.where(F.col("kind").isin(*TYPED_KINDS))
        .withColumn("container", F.explode("containers"))
        .withColumn("env", env)
    )


def plan_create(plan: DataFrame, settings: Settings = DEFAULTS, slice_width: int | None = None) -> DataFrame:
    """Objects to create, with their labels; Pods and Jobs are typed, the rest generic."""
    creates = merge_labels(plan.where(F.col("operation") == "create"), settings, slice_width)
    return creates.select(
        *ROW, "ts", "resource", "kind", "target_namespace", "name",
        F.when(F.col("kind").isin(*TYPED_KINDS), "typed").otherwise("generic").alias("client"),
        "labels", F.size("containers").alias("n_containers"),
    )


def _with_resources(plan: DataFrame, resources: DataFrame) -> DataFrame:
    live = resources.select(
        "kind", F.col("namespace").alias("target_namespace"), "name",
        F.lit(True).alias("_exists"), F.col("replicas").alias("_replicas"),
    )
    return plan.join(live, OBJECT, "left").withColumn("_exists", F.coalesce("_exists", F.lit(False)))


def _numbered(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Events of a generation with the number of the idle check that they block, as in ``state.busy_ticks``."""
    clock = runs.select(*RUN, micros(F.col("valid_from")).alias("_a"), (F.col("idle_s") * 1_000_000).alias("_d"))
    offset = micros(F.col("ts")) - F.col("_a")
    return events.join(clock, RUN).where(offset >= 0).withColumn("_k", ceil_div(offset, F.col("_d")))


def run_history(plan: DataFrame, runs: DataFrame) -> DataFrame:
    """What later events of a generation need to know: first event, last number of an idle check, object deleted."""
    first = F.min(F.struct(*ORDER, "namespace")).alias("first")
    seen = _earliest(plan, RUN).groupBy(*RUN).agg(first)
    last = _numbered(plan.where(F.col("operation") == "scale").select(*RUN, "ts"), runs).groupBy(*RUN).agg(F.max("_k").alias("last_k"))
    return seen.join(last, RUN, "left")


def later_history(before: DataFrame, here: DataFrame) -> DataFrame:
    """History after a batch, for the generations that the batch has."""
    old = before.select(*RUN, F.col("first").alias("_first"), F.col("last_k").alias("_last_k"))
    return here.join(old, RUN, "left").select(*RUN, F.coalesce("_first", "first").alias("first"), F.greatest("last_k", "_last_k").alias("last_k"))


def _run_facts(plan: DataFrame, resources: DataFrame, history: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """What holds for a whole generation: namespace, object state at the start, first event.

    ``history`` has generations seen before this plan, ``deleted`` the objects deleted before it.

    The object of a generation is fixed once its namespace is, so object lookups and the
    first delete of an object need one row per generation, not one per event.
    """
    of_object = ["operation", "kind", "resource", "object_namespace", "name"]
    firsts = (
        _earliest(plan, [*RUN, *of_object]).groupBy(*RUN, *of_object)
        .agg(F.min(F.struct(*ORDER, "namespace")).alias("_f"))
    )
    if history is not None:
        firsts = firsts.join(history.select(*RUN, F.col("first").alias("_h")), RUN, "left").withColumn("_f", F.coalesce("_h", "_f")).drop("_h")
    facts = _with_resources(firsts.withColumn("target_namespace", _namespace("_f.namespace")), resources)
    there = F.col("_exists")
    if deleted is not None:
        facts = facts.join(deleted.select(*OBJECT, F.lit(True).alias("_gone")), OBJECT, "left")
        there = there & F.col("_gone").isNull()
    deleter = Window.partitionBy("operation", *OBJECT).orderBy("_f", *RUN)
    return facts.withColumn("_deletes", (F.col("operation") == "delete") & there & (F.row_number().over(deleter) == 1)).select(
        *RUN, "target_namespace", "_exists", "_replicas", "_deletes",
        *[F.col(f"_f.{c}").alias(f"_first_{c}") for c in IDENTITY],
    )


def run_knowledge(
    few: DataFrame, sensors: DataFrame, resources: DataFrame, runs: DataFrame | None = None, history: DataFrame | None = None, deleted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """What plan rows know from others before they are made, for ``routing.route_deciding(know=)``: of their generation its object and facts, and,
    given ``runs``, of their event the generations that it wakes. ``few`` are the planned and stored rows that decide this.
    """
    known = as_table(sensor_objects(sensors).join(_run_facts(few, resources, history, deleted), "sensor_key"))
    if runs is None:
        return known, None
    wakes = _wakeups(few, runs, history).groupBy(*IDENTITY).agg(F.collect_set(F.struct(*RUN)).alias("_wakes_for"))
    return known, as_table(wakes)


def _is_first() -> Column:
    same = [F.col(c) == F.col(f"_first_{c}") for c in IDENTITY]
    return same[0] & same[1] & same[2]


def _wakeups(plan: DataFrame, runs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Scale events that follow an idle firing of their sensor (see :func:`_woken` for what the firing did).

    Idle checks are numbered as in ``state.busy_ticks``. A check fired between two events
    exactly when their numbers differ by two or more, and only the first event of a number
    can follow it, so one row per (generation, number) is enough.
    """
    numbered = _numbered(plan.where(F.col("operation") == "scale").select(*ROW, "ts"), runs)
    firsts = numbered.groupBy(*RUN, "_k").agg(F.min(F.struct(*ORDER)).alias("f"))
    earlier = F.lit(0)
    if history is not None:
        firsts = firsts.join(history.select(*RUN, "last_k"), RUN, "left")
        earlier = F.coalesce("last_k", F.lit(0))
    before = F.coalesce(F.lag("_k").over(Window.partitionBy(*RUN).orderBy("_k")), earlier)
    return (
        firsts.withColumn("_gap", F.col("_k") - before)
        .where("_gap >= 2")
        .select(*RUN, *[f"f.{c}" for c in IDENTITY], F.lit(True).alias("_wakes"))
    )


def _woken() -> Column:
    """The idle firing before the event has scaled the same object to zero (as :func:`plan_scale_zero` plans it).

    After the first event of a generation the object is there and its namespace is settled. Before it, the firing
    looked in the namespace of the object or the default one, and found only what was there at the start.
    """
    same = F.col("_exists") & (F.col("target_namespace") == _namespace(F.lit(None).cast("string")))
    return F.col("_wakes") & (~_is_first() | same)


def _handled(
    plan: DataFrame, resources: DataFrame, runs: DataFrame | None, history: DataFrame | None = None, deleted: DataFrame | None = None,
    few: DataFrame | None = None,
) -> DataFrame:
    """Plan rows with the facts of their generation and, for scaling, the state before the event; the facts come from ``few`` if given.

    Rows that were routed with them (:func:`run_knowledge`) do not look for them again.
    """
    deciding = plan if few is None else few
    full = plan if "_deletes" in plan.columns else plan.join(F.broadcast(_run_facts(deciding, resources, history, deleted)), RUN)
    if runs is None:
        return full
    if "_wakes_for" in plan.columns:
        wakes = F.array_contains("_wakes_for", F.struct(*RUN))
    else:
        full, wakes = full.join(as_table(_wakeups(deciding, runs, history)), ROW, "left"), F.col("_wakes")
    full = full.withColumn("_wakes", F.coalesce(wakes, F.lit(False)))
    scaling = F.col("operation") == "scale"
    creates = scaling & _is_first() & ~F.col("_exists")
    at_start = F.when(creates, F.coalesce("template_replicas", F.lit(1))).otherwise(F.coalesce("_replicas", F.lit(1)))
    before = F.when(_woken() & ~creates, F.lit(0)).when(_is_first(), at_start).otherwise(F.lit(1))
    scalable = F.col("kind").isin(*SCALABLE_KINDS)
    return full.withColumns(
        {
            "_creates": creates,
            "_patches": scaling & scalable & (before < 1),
            "error": F.when(scaling & ~scalable, F.lit("kind.not_scalable")).otherwise(F.col("error")),
        }
    )


def _scale_action() -> Column:
    return (
        F.when(F.col("_creates") & F.col("_patches"), "create+patch")
        .when(F.col("_creates"), "create")
        .when(F.col("_patches"), "patch")
        .otherwise("none")
    )


def _outcome() -> Column:
    return F.when(F.col("error").isNotNull(), "error").when(F.col("action") == "none", "noop").otherwise("ok")


def _delete_action() -> Column:
    return F.when(F.col("_deletes") & _is_first(), "delete").otherwise("none")


def plan_delete(plan: DataFrame, resources: DataFrame) -> DataFrame:
    """Delete events: the first one of an existing object deletes, all others do nothing."""
    deletes = _handled(plan.where(F.col("operation") == "delete"), resources, None)
    return deletes.withColumn("action", _delete_action()).withColumn("outcome", _outcome()).select(*LEDGER)


def plan_scale_up(plan: DataFrame, resources: DataFrame, runs: DataFrame) -> DataFrame:
    """Scale events: create an absent object, then raise the replicas to one if at zero.

    ``resources`` is the state at the start of each generation; ``runs`` are generations with
    their idle periods.
    """
    scales = _handled(plan.where(F.col("operation") == "scale"), resources, runs)
    return scales.withColumn("action", _scale_action()).withColumn("outcome", _outcome()).select(*LEDGER)


def action_ledger(
    plan: DataFrame, resources: DataFrame, runs: DataFrame, history: DataFrame | None = None, deleted: DataFrame | None = None,
    few: DataFrame | None = None,
) -> DataFrame:
    """One row per event and sensor: action, outcome and error, for all operations at once.

    ``plan`` comes from :func:`plan_actions`. Given what was before (``history`` from :func:`run_history`, ``deleted``
    objects), it continues there. ``few`` are those of its rows that decide the facts of generations (``routing.route_deciding``, planned
    and stored); with them the plan itself is read once.
    """
    op = F.col("operation")
    action = (
        F.when(op == "scale", _scale_action())
        .when(op == "delete", _delete_action())
        .when(op == "create", "create")
        .otherwise("none")
    )
    return _handled(plan, resources, runs, history, deleted, few).withColumn("action", action).withColumn("outcome", _outcome()).select(*LEDGER)


def ledger_summary(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("sensor_key", "operation", "outcome").agg(F.count("*").alias("n"))


def scaling_runs(runs: DataFrame, sensors: DataFrame) -> DataFrame:
    """The generations whose idle checks the ledger asks for: those of scaling sensors."""
    return runs.join(sensors.where("actor.operation = 'scale'").select("sensor_key").distinct(), "sensor_key", "left_semi")


def plan_scale_zero(gaps: DataFrame, routed: DataFrame, sensors: DataFrame, resources: DataFrame) -> DataFrame:
    """Patches to zero replicas for idle firings, whatever the operation of the sensor.

    ``gaps`` comes from ``state.idle_gaps``. A gap lies wholly before or after an event, so it is planned as one row
    and expanded to its firings last. An object exists when the snapshot has it, or after the first event of a sensor that
    creates or scales it; after the first event of a deleting sensor it is gone.
    """
    first = _earliest(routed, RUN).groupBy(*RUN).agg(F.min(F.struct(*ORDER, "namespace")).alias("_f"))
    touched = F.coalesce(F.col("_f.ts") <= fire_time("lo"), F.lit(False))
    placed = (
        gaps.join(sensor_objects(sensors).drop("object_labels", "containers", "template_replicas"), "sensor_key")
        .join(first, RUN, "left")
        .withColumn("touched", touched)
        .withColumn("_sticky", F.when(touched, F.col("_f.namespace")))
        .withColumn("target_namespace", _namespace("_sticky"))
        .drop("_f", "_sticky")
    )
    op = F.col("operation")
    exists = (
        F.when(F.col("touched") & op.isin("create", "scale"), True)
        .when(F.col("touched") & (op == "delete"), False)
        .otherwise(F.col("_exists"))
    )
    error = F.when(~F.col("kind").isin(*SCALABLE_KINDS), F.lit("kind.not_scalable")).when(
        (F.col("kind") == "StatefulSet") & ~exists, "object.not_found"
    )
    planned = (
        _with_resources(placed, resources)
        .withColumn("error", error)
        .withColumn("action", F.when(F.col("error").isNull() & exists, "patch_zero").otherwise("none"))
        .select(*RUN, "a", "d", "lo", "hi", "kind", "target_namespace", "name", "action", _outcome().alias("outcome"), "error")
    )
    return ticks_between(planned, "lo", "hi").select(
        *RUN, fire_time("k").alias("fire_ts"), "kind", "target_namespace", "name", "action", "outcome", "error"
    )

