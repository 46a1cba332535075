"""Identity of records across catalogs, and merging of sources into one canonical record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.operators.shared import forget, small, written


def resolve(existing: DataFrame, incoming: DataFrame, id: str, strong: list[str], title: str, signals: list[str], conflict: str | None = None, least: int = 2) -> DataFrame:
    """One row per incoming record: (id, target, via), via one of ``strong`` (in order), multi_field,
    ambiguous (a title alone, or a conflict) or new.

    The existing side is reduced to one candidate per key before each join, the first by id, so a common
    title never multiplies rows. Records whose ``conflict`` keys (such as DOIs) both exist and differ never
    match: the reduction keeps the first candidate without that key beside the first of all.
    ``least`` of the signals must agree beside the title; only 2 of at least two signals are supported,
    each pair being an equi-join."""
    if least != 2:
        raise ValueError("two signals, no other number")
    free = F.col(conflict).isNull() if conflict else F.lit(True)
    keys = [(k, [k]) for k in strong] + [(f"multi_field:{a}:{b}", [title, a, b]) for i, a in enumerate(signals) for b in signals[i + 1 :]] + [("ambiguous", [title])]
    out = incoming
    choices: list[tuple[str, Column]] = []
    for n, (name, cols) in enumerate(keys):
        named = existing
        for c in cols:
            named = named.where(F.col(c).isNotNull())
        first = named.groupBy(*cols).agg(F.min(id).alias(f"_any{n}"), F.min(F.when(free, F.col(id))).alias(f"_free{n}"))
        out = out.join(first, cols, "left")
        if conflict and cols != [conflict]:
            pick = F.when(F.col(conflict).isNull(), F.col(f"_any{n}")).otherwise(F.col(f"_free{n}"))
        else:
            pick = F.col(f"_any{n}")
        choices.append((name, F.col(f"_any{n}") if name == "ambiguous" else pick))
    via = F.lit(None).cast("string")
    target = F.coalesce(F.lit(None), *[c for name, c in choices if name in strong])
    multi = F.least(*[c for name, c in choices if name.startswith("multi_field")]) if len(signals) > 2 else choices[len(strong)][1]
    for name, c in reversed([x for x in choices if x[0] in strong]):
        via = F.when(c.isNotNull(), F.lit(name)).otherwise(via)
    via = F.coalesce(via, F.when(multi.isNotNull(), F.lit("multi_field")), F.when(choices[-1][1].isNotNull(), F.lit("ambiguous")), F.lit("new"))
    return out.select(F.col(id), F.coalesce(target, multi).alias("target"), via.alias("via"))


def multi_field(existing: DataFrame, incoming: DataFrame, id: str, title: str, signals: list[str], repository: str, repositories: str, conflict: str | None = None) -> DataFrame:
    """(id, target) of incoming records that share a title and at least two signals with an existing record.

    A signal is a value, or an array of which one member in common is enough. A match needs another
    repository: the ``repository`` of the incoming record is not among the array ``repositories`` of the existing
    one. Differing ``conflict`` keys (such as DOIs) forbid a match;
    records that both have one are left to :func:`resolve`, which matches equal ones. The target is the first by id. Null titles, signals and
    members agree with nothing; a record without a repository meets all.

    Each pair of signals is an equi-join on title and members. The existing side is reduced per key to the
    first record of each set of repositories, so a common title adds no rows; the sets are as many as the
    catalogs make, not the records."""
    free = F.col(conflict).isNull() if conflict else F.lit(True)
    held = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(repositories, F.array().cast("array<string>")))))

    def opened(df: DataFrame, pair: tuple[str, str], extra: list[Column]) -> DataFrame:
        out = df.where(F.col(title).isNotNull()).select(id, F.col(title).alias("_t"), *[F.col(c).alias(n) for n, c in zip(("_a", "_b"), pair, strict=True)], *extra)
        for n, c in zip(("_a", "_b"), pair, strict=True):
            if df.schema[c].dataType.typeName() == "array":
                out = out.withColumn(n, F.explode(F.array_distinct(n)))
        return out.where("_a is not null and _b is not null")

    found = None
    for i, a in enumerate(signals):
        for b in signals[i + 1 :]:
            left = opened(existing, (a, b), [held.alias("_r"), free.alias("_f")])
            sets = left.groupBy("_t", "_a", "_b", "_r").agg(F.min(id).alias("_any"), F.min(F.when(F.col("_f"), F.col(id))).alias("_free"))
            keys = sets.groupBy("_t", "_a", "_b").agg(F.collect_list(F.struct("_r", "_any", "_free")).alias("_c"))
            asked = opened(incoming, (a, b), [F.col(repository).alias("_q"), (F.col(conflict).isNull() if conflict else F.lit(True)).alias("_w")])
            other = F.filter("_c", lambda c: ~F.coalesce(F.array_contains(c["_r"], F.col("_q")), F.lit(False)))
            target = F.array_min(F.transform(other, lambda c: F.when(F.col("_w"), c["_any"]).otherwise(c["_free"])))
            part = asked.join(keys, ["_t", "_a", "_b"]).select(id, target.alias("target"))
            found = part if found is None else found.unionByName(part)
    return found.where("target is not null").groupBy(id).agg(F.min("target").alias("target"))


def first_filled(value: Column, seq: Column) -> Column:
    """Aggregate: the first value that is not null, by ``seq``."""
    return F.min_by(value, F.when(value.isNotNull(), seq))


def union_in_order(values: Column, seq: Column) -> Column:
    """Aggregate: distinct values by first appearance."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_set(F.struct(seq.alias("s"), values.alias("v")))), lambda x: x["v"]))


#: Sources of one record that are gathered as rows; 1,000 characters of raw texts and entries, or members of lists, count as one more.
GATHERED = 500


def absorb(
    canonical: DataFrame, sources: DataFrame, id: str, order: str, scalars: list[str], lists: list[str], ages: str = "ages", age_groups: str = "age_groups",
    fill: list[str] = (), entry: str | None = None, retrieved: str | None = None,
) -> DataFrame:
    """Canonical records with their matched ``sources`` merged in, one row per record.

    ``sources`` has ``id`` of its record, ``order`` (not null, unique in a record), ``repository``, ``source_id``, ``raw``, ``via`` and the fields;
    ``canonical`` has ``id`` and the fields. A scalar is the first that is filled (not null, not an empty text or array), the
    record's own before those of sources in order. A list is the union by first appearance, never null; a list of ``fill`` is the first
    that is not empty, whole, else empty. The age groups are
    worked out from the merged ``ages``, and are their union only where these give none. ``source_keys`` are
    repository:source_id by first appearance, ``raw`` keeps the last raw text of each repository, ``matched_via`` is the
    last way of matching. With ``entry``, ``sources`` holds one (key, entry) per source key by first appearance, each the last
    entry of its key; with ``retrieved``, ``updated_at`` is that of the last source, null or not. What ``canonical`` already has
    in columns source_keys, raw, sources, matched_via, updated_at is carried on. Sources of unknown records are dropped; a record
    without sources keeps its fields.

    Sources are counted by record first. Those of a record meet in one shuffle, with the record, and are gathered as rows. A record of more than
    GATHERED sources is merged by its distinct members and keys, which are reduced before they are gathered, so one that a third of all
    sources belongs to takes no more room than its distinct values."""
    options = (id, order, scalars, lists, ages, age_groups, fill, entry, retrieved)
    if entry and any(t in sources.schema[entry].dataType.simpleString() for t in ("map<", "variant")):
        return _merged_by_value(canonical, sources, *options)  # rows with such values can't be sorted
    size = sum((F.coalesce(F.size(F.col(c)), F.lit(0)) for c in (*lists, ages, age_groups)), F.lit(0))
    for c in {"raw", entry or "raw"}:
        size = size + F.coalesce(F.length(F.col(c).cast("string")), F.lit(0))
    counted = sources.where(F.col(id).isNotNull()).groupBy(id).agg(F.sum(1 + F.floor(size / 1000)).alias("n"))
    crowded = written(counted.where(F.col("n") > GATHERED).select(id), "crowded")
    if crowded.isEmpty():
        forget(crowded)
        return _merged_by_record(canonical, sources, *options)
    crowded = small(crowded)
    few = _merged_by_record(canonical.join(crowded, id, "left_anti"), sources.join(crowded, id, "left_anti"), *options)
    return few.unionByName(_merged_by_value(canonical.join(crowded, id, "left_semi"), sources.join(crowded, id, "left_semi"), *options))


def _filled(canonical: DataFrame, c: str) -> Column:
    v = F.col(c)
    return v.isNotNull() & (F.size(v) > 0 if canonical.schema[c].dataType.typeName() == "array" else v.cast("string") != "")


def _merged_by_record(
    canonical: DataFrame, sources: DataFrame, id: str, order: str, scalars: list[str], lists: list[str], ages: str, age_groups: str, fill: list[str], entry: str | None, retrieved: str | None
) -> DataFrame:
    """:func:`absorb` by one grouping: the sources of a record are gathered and merged in their order."""
    names = {**{c: c for c in lists}, ages: ages, age_groups: age_groups}
    last = {"matched_via": "via", **({"updated_at": retrieved} if retrieved else {})}
    held = [c for c in ("source_keys", "raw", *(["sources"] if entry else [])) if c in canonical.columns]
    none = F.array(F.lit(None).cast("string"))

    def rows(df: DataFrame, own: int, at: Column, more: list[Column]) -> DataFrame:
        members = [F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")).alias(f"_{c}") for c in names]
        return df.select(id, F.struct(F.lit(own).alias("own"), at.alias("at")).alias("_seq"), *scalars, *fill, *members, *more)

    was = [F.col(c).alias(f"_{c}") for c in (*held, *last) if c in canonical.columns]
    key = F.concat_ws(":", "repository", "source_id")
    met = [key.alias("_key"), F.struct(F.col("repository").alias("key"), F.col("raw").alias("value")).alias("_text")]
    met += [F.struct(key.alias("key"), F.col(entry).alias("entry")).alias("_entry")] if entry else []
    stored = rows(canonical, 0, F.lit(None).cast(sources.schema[order].dataType), was)
    come = rows(sources.where(F.col(id).isNotNull()), 1, F.col(order), met + [F.col(v).alias(f"_{c}") for c, v in last.items()])
    both = stored.unionByName(come, allowMissingColumns=True)
    gathered = [f"_{c}" for c in names] + ["_key", "_text", *(["_entry"] if entry else [])]
    first = [F.min_by(c, F.when(_filled(canonical, c), F.col("_seq"))).alias(c) for c in (*scalars, *fill)]
    ends = [F.max_by(f"_{c}", "_seq").alias(c) for c in last]
    before = [F.flatten(F.collect_list(F.map_entries("_raw") if c == "raw" else f"_{c}")).alias(f"_{c}") for c in held]
    out = both.groupBy(id).agg(*first, *ends, *before, F.sort_array(F.collect_list(F.struct("_seq", *gathered))).alias("_g"))
    out = out.where("_g[0]._seq.own = 0").withColumn("_s", F.filter("_g", lambda e: e["_seq"]["own"] == 1))
    united = {c: F.array_except(F.flatten(F.col("_g")[f"_{c}"]), none).cast(canonical.schema[c].dataType.simpleString()) for c in names}  # distinct, by first appearance
    out = out.withColumns({c: v for c, v in united.items() if c != age_groups})

    def with_held(c: str, value: Column) -> Column:
        return F.concat(f"_{c}", value) if c in held else value

    def lasting(keys: Column, pairs: str) -> Column:
        """The last of ``pairs`` of each of the keys."""
        return F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"].eqNullSafe(k)), -1))

    out = out.withColumn("_raws", with_held("raw", F.col("_s")["_text"]))
    raws = F.map_from_entries(lasting(F.sort_array(F.array_except(F.col("_raws")["key"], none)), "_raws"))
    more = list(last)
    if entry:
        out = out.withColumn("_entries", with_held("sources", F.col("_s")["_entry"]))
        more.append(F.when(F.size("_entries") > 0, lasting(F.array_distinct(F.col("_entries")["key"]), "_entries")).alias("sources"))
    whole = [F.coalesce(c, F.array().cast(canonical.schema[c].dataType.simpleString())).alias(c) for c in fill]
    groups = F.coalesce(T.age_groups(F.col(ages)), united[age_groups]).alias(age_groups)
    keys = F.array_distinct(with_held("source_keys", F.col("_s")["_key"]))
    return out.select(id, *scalars, *whole, *lists, ages, groups, keys.alias("source_keys"), F.when(F.size(raws) > 0, raws).alias("raw"), *more)


def _merged_by_value(
    canonical: DataFrame, sources: DataFrame, id: str, order: str, scalars: list[str], lists: list[str], ages: str, age_groups: str, fill: list[str], entry: str | None, retrieved: str | None
) -> DataFrame:
    """:func:`absorb` by distinct values: members and keys are reduced to distinct ones before they are gathered."""
    names = {**{c: c for c in lists}, ages: ages, age_groups: age_groups}
    fields = [*scalars, *fill, *names]
    at = sources.schema[order].dataType
    own = canonical.select(id, F.lit(0).alias("_own"), F.lit(None).cast(at).alias("_at"), *fields)
    known = sources.join(canonical.select(id), id, "left_semi")
    rows = own.unionByName(known.select(id, F.lit(1).alias("_own"), F.col(order).alias("_at"), *fields))
    seq = F.struct("_own", "_at")

    one = rows.groupBy(id).agg(*[F.min_by(c, F.when(_filled(canonical, c), seq)).alias(c) for c in (*scalars, *fill)])
    tagged = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("array<string>").alias("v")) for c in names])
    members = rows.select(id, "_own", "_at", F.explode(tagged).alias("x")).select(id, "_own", "_at", "x.f", F.posexplode("x.v").alias("pos", "v")).where("v is not null")
    first = members.groupBy(id, "f", "v").agg(F.min(F.struct("_own", "_at", "pos")).alias("s"))
    united = first.groupBy(id).agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("f") == c, F.struct("s", "v")))), lambda x: x["v"]).alias(f"_{c}") for c in names])

    def before(column: str, key: Column, value: Column) -> DataFrame:
        """What the records have in ``column``, as (id, k, v, s): keys and values, before those of all sources."""
        x = canonical.select(id, F.posexplode(column).alias("pos", *(("k0", "v0") if canonical.schema[column].dataType.typeName() == "map" else ("e",))))
        return x.select(id, key.cast("string").alias("k"), value.alias("v"), F.struct(F.lit(0).alias("_own"), F.lit(None).cast(at).alias("_at"), "pos").alias("s"))

    def after(key: Column, value: Column) -> DataFrame:
        return known.select(id, key.cast("string").alias("k"), value.alias("v"), F.struct(F.lit(1).alias("_own"), F.col(order).alias("_at"), F.lit(0).alias("pos")).alias("s"))

    key = F.concat_ws(":", "repository", "source_id")
    held = after(key, F.lit(None).cast("string"))
    if "source_keys" in canonical.columns:
        held = before("source_keys", F.col("e"), F.lit(None).cast("string")).unionByName(held)
    keys = held.groupBy(id, "k").agg(F.min("s").alias("s")).groupBy(id).agg(F.transform(F.sort_array(F.collect_list(F.struct("s", "k"))), lambda x: x["k"]).alias("source_keys"))
    raws = after(F.col("repository"), F.col("raw")).where("k is not null")
    if "raw" in canonical.columns:
        raws = before("raw", F.col("k0"), F.col("v0")).unionByName(raws)
    raws = raws.groupBy(id, "k").agg(F.max_by("v", "s").alias("raw"))
    raws = raws.groupBy(id).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "raw")))).alias("raw"))
    last = [F.max_by("via", order).alias("matched_via")] + ([F.max_by(retrieved, order).alias("updated_at")] if retrieved else [])
    via = known.groupBy(id).agg(*last, F.lit(True).alias("_met"))
    out = one.join(united, id, "left").join(keys, id, "left").join(raws, id, "left").join(via, id, "left")
    more = ["matched_via", *(["updated_at"] if retrieved else [])]
    for c in more:
        if c in canonical.columns:
            out = out.join(canonical.select(id, F.col(c).alias("_was")), id).withColumn(c, F.when(F.col("_met"), F.col(c)).otherwise(F.col("_was"))).drop("_was")
    if entry:
        entries = after(key, F.col(entry))
        if "sources" in canonical.columns:
            entries = before("sources", F.col("e.key"), F.col("e.entry")).unionByName(entries)
        entries = entries.groupBy(id, "k").agg(F.min("s").alias("s"), F.max_by("v", "s").alias("entry"))
        entries = entries.groupBy(id).agg(F.transform(F.sort_array(F.collect_list(F.struct("s", F.col("k").alias("key"), "entry"))), lambda x: F.struct(x["key"].alias("key"), x["entry"].alias("entry"))).alias("sources"))
        out = out.join(entries, id, "left")
        more.append("sources")
    types = {c: canonical.schema[c].dataType.simpleString() for c in names}
    value = {c: F.coalesce(F.col(f"_{c}"), F.array().cast("array<string>")).cast(types[c]) for c in names}
    value[age_groups] = F.coalesce(T.age_groups(value[ages]), value[age_groups])
    whole = [F.coalesce(c, F.array().cast(canonical.schema[c].dataType.simpleString())).alias(c) for c in fill]
    return out.select(id, *scalars, *whole, *[v.alias(c) for c, v in value.items()], F.coalesce("source_keys", F.array().cast("array<string>")).alias("source_keys"), "raw", *more)


def violations(**rules: Column) -> Column:
    """Names of the rules a record breaks, in the order given. A null test counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
