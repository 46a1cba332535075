"""The canonical upsert: each source, in order, is merged into the record it belongs to or becomes a record.

Merging widens a record (its DOI, source keys, repositories, authors, modalities), so a later source may match through what an
earlier one brought. The fold goes on in slices: one task goes through the LOOP earliest sources in order, with the records that they could
come to, and gives out the records as it leaves them; these replace the former ones and the next slice follows. So a task holds a slice, whatever the
input, and chains of sources that depend on one another take no rounds. By title and signals a source comes to the earliest record that lets it in,
and a slice can shut no more records of a title than it has sources of that title; so of the records alike to such sources only that many and one more go along.
Where even few sources could come to more than LOOP_RECORDS records, a round of joins decides all the sources
that no earlier undecided source can have to do with. The result is that of a loop over all sources.
"""

from __future__ import annotations

from bisect import bisect
from functools import reduce
from heapq import heappop, heappush
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curatrix.operators.graph import labelled
from curatrix.operators.shared import forget, written

#: Ways of matching, the strongest first.
WAYS = ("doi", "cross_reference", "source_url", "source_key", "multi_field")
LISTS, SCALARS = ("authors", "modality"), ("participants", "year")
STRINGS = "array<string>"
#: Undecided sources, and records they could meet, that one task may go through.
LOOP, LOOP_RECORDS = 30_000, 100_000
#: Sizes of a slice that are tried, each half of the one before, until a round is taken instead.
HALVES = 6


def _place(kind: str, *values: Column) -> Column:
    """A name for a value that rows and records may have in common; null where a part is."""
    whole = F.lit(True)
    for v in values:
        whole = whole & v.isNotNull()
    return F.when(whole, F.md5(F.to_json(F.struct(F.lit(kind).alias("k"), *[v.cast("string").alias(f"v{i}") for i, v in enumerate(values)]))))


def _one(c: str) -> Column:
    return F.array_compact(F.array(F.col(c).cast("string")))


def _many(c: str) -> Column:
    return F.array_distinct(F.array_compact(F.coalesce(F.col(c).cast(STRINGS), F.array().cast(STRINGS))))


def _pairs(place=_place) -> Column:
    """Places of a title with values of two signals: who shares one shares the title and two signals."""
    signals = [("authors", _many("authors")), ("participants", _one("participants")), ("modality", _many("modality")), ("year", _one("year"))]

    def met(a: str, xs: Column, b: str, ys: Column) -> Column:
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: place("pair", F.col("title"), F.lit(a), x, F.lit(b), y))))

    out = [met(*x, *y) for i, x in enumerate(signals) for y in signals[i + 1 :]]
    return F.when(F.col("title").isNotNull(), F.array_compact(F.concat(*out))).otherwise(F.array())


def _kinds(**places: Column) -> Column:
    """Structs (kind, pos, place) of arrays of places by kind."""

    def named(kind: str, p: Column) -> Column:
        return F.transform(p, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.alias("place")))

    return F.flatten(F.array(*[named(k, p) for k, p in places.items()]))


def _held() -> Column:
    """What a record can be found by."""
    keys = F.transform(_many("source_keys"), lambda k: _place("key", k))
    return _kinds(doi=F.array_compact(F.array(_place("doi", F.col("doi")))), source_url=F.array_compact(F.array(_place("url", F.col("url")))), source_key=keys, multi_field=_pairs())


def _sought() -> Column:
    """What a source looks for."""
    refs = F.transform(_many("refs"), lambda k: _place("key", k))
    return _kinds(
        doi=F.array_compact(F.array(_place("doi", F.col("doi")))), cross_reference=refs, source_url=F.array_compact(F.array(_place("url", F.col("url")))),
        source_key=F.array_compact(F.array(_place("key", F.col("source_key")))), multi_field=_pairs(),
    )


def _two_least(classed: DataFrame, on: str) -> DataFrame:
    """Per ``on``: the least seq and its class (seq1, class1), and the least seq of any other class (seq2, class2)."""
    by_class = classed.groupBy(on, "class").agg(F.min("seq").alias("seq"))
    first = by_class.groupBy(on).agg(F.min(F.struct("seq", "class")).alias("one"))
    other = labelled(by_class, first, on, "class").where(F.col("class") != F.col("one.class")).groupBy(on).agg(F.min(F.struct("seq", "class")).alias("two"))
    return first.join(other, on, "left").select(on, F.col("one.seq").alias("seq1"), F.col("one.class").alias("class1"), F.col("two.seq").alias("seq2"), F.col("two.class").alias("class2"))


def _earlier() -> Column:
    """Whether a row of another class comes before this one."""
    return F.coalesce(F.when(F.col("class1") != F.col("class"), F.col("seq1") < F.col("seq")).otherwise(F.col("seq2") < F.col("seq")), F.lit(False))


def _state(records: DataFrame, decided: DataFrame | None) -> DataFrame:
    """Records with all decided sources merged in, as far as identity goes. ``records`` may be a state itself, if none of its sources comes after one of ``decided``.

    DOI, participants and year are the first that are filled; keys, repositories, authors and modalities are united; the
    address and the title stay those that the record began with."""
    created = F.col("created") if "created" in records.columns else F.lit(-1)
    base = records.select(
        "id", created.cast("long").alias("seq"), F.lit(True).alias("first"), "doi", "url", "title", "source_keys", "repositories", *[F.col(c).cast(STRINGS).alias(c) for c in LISTS], *SCALARS
    )
    if decided is None:
        rows = base
    else:
        kept = decided.where("target is not null")
        rows = base.unionByName(
            kept.select(
                F.col("target").alias("id"), "seq", (F.col("action") == "inserted").alias("first"), "doi", "url", "title", F.array("source_key").alias("source_keys"), F.array("repository").alias("repositories"),
                *[F.col(c).cast(STRINGS).alias(c) for c in LISTS], *SCALARS,
            )
        )
    # sets are reduced to distinct members before they are gathered
    tagged = F.array(*[F.struct(F.lit(c).alias("f"), _many(c).alias("v")) for c in ("source_keys", "repositories", *LISTS)])
    members = rows.select("id", F.explode(tagged).alias("x")).select("id", "x.f", F.explode("x.v").alias("v")).distinct()
    sets = members.groupBy("id").agg(*[F.array_sort(F.collect_list(F.when(F.col("f") == c, F.col("v")))).alias(c) for c in ("source_keys", "repositories", *LISTS)])
    filled = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("seq"))).alias(c) for c in ("doi", *SCALARS)]
    kept = [F.min_by(c, F.when(F.col("first"), F.col("seq"))).alias(c) for c in ("url", "title")]
    out = rows.groupBy("id").agg(F.min("seq").alias("created"), *filled, *kept).join(sets, "id", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(STRINGS)) for c in ("source_keys", "repositories", *LISTS)})


def _found(records: DataFrame, rows: DataFrame) -> DataFrame:
    """(seq, way, target, sure) of undecided rows: how each would be decided now, and whether nothing can change that."""
    held = records.select("id", "created", "doi", "repositories", F.explode("held").alias("p")).select("id", "created", "doi", "repositories", "p.kind", "p.place")
    candidate = F.struct("created", "id", "doi")
    sets = held.withColumn("repositories", F.when(F.col("kind") == "multi_field", F.col("repositories")))
    sets = sets.groupBy("place", "repositories").agg(F.min(candidate).alias("any"), F.min(F.when(F.col("doi").isNull(), candidate)).alias("free"))
    known = sets.groupBy("place").agg(F.min("any").alias("first"), F.collect_list(F.struct("repositories", "any", "free")).alias("sets"))
    sought = rows.select("seq", "repository", "doi", F.explode("sought").alias("p")).select("seq", "repository", F.col("doi").alias("own"), "p.kind", "p.pos", "p.place")
    met = labelled(sought, known, "place", "seq")
    none = F.lit(None).cast("struct<created:bigint,id:string,doi:string>")
    apart = F.filter("sets", lambda s: ~F.array_contains(F.coalesce(s["repositories"], F.array().cast(STRINGS)), F.col("repository")))
    by_pair = F.array_min(F.transform(apart, lambda s: F.when(F.col("own").isNull(), s["any"]).otherwise(s["free"])))
    clash = F.col("own").isNotNull() & F.col("first.doi").isNotNull() & (F.col("own") != F.col("first.doi"))
    met = met.withColumn("c", F.when(F.col("kind") == "multi_field", by_pair).otherwise(F.when(clash, none).otherwise(F.col("first"))))
    strength = F.element_at(F.create_map(*[x for i, w in enumerate(WAYS) for x in (F.lit(w), F.lit(i))]), F.col("kind"))
    # of the pairs the earliest record counts, of the references the first
    order = F.struct(strength.alias("s"), F.when(F.col("kind") == "multi_field", F.lit(0)).otherwise(F.col("pos")).alias("p"), "c")
    best = met.where("c is not null").groupBy("seq").agg(F.min(F.struct(order.alias("o"), F.col("kind"))).alias("b"))
    out = rows.select("seq", F.col("doi").alias("own"), F.col("url").alias("own_url"), F.size(_many("refs")).alias("n_refs")).join(best, "seq", "left")
    way = F.col("b.kind")
    # nothing stronger can turn up, and no DOI can forbid it
    sure = (way == "doi") | (F.col("own").isNull() & (F.col("n_refs") == 0) & ((way == "source_url") | ((way == "source_key") & F.col("own_url").isNull())))
    return out.select("seq", way.alias("way"), F.col("b.o.c.id").alias("target"), F.coalesce(sure, F.lit(False)).alias("sure"))


def _ready(records: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` of the rows that no earlier undecided row of another class can have to do with.

    Rows sure of one record are a class: their order does not matter. A row may wait for rows that seek a place it seeks, for rows
    that could meet the record it goes to, or, if it has found none or by title only, any record of its title, and for rows
    of the title of the record it would widen. Rows that are sure of records only bring titles and signals, so they do not wait for one another by these. Sources of one repository never meet by title and signals, so they do not wait for one another
    where every record at hand has their repository."""
    own = F.when(F.col("sure"), F.concat(F.lit("r:"), "target")).otherwise(F.concat(F.lit("s:"), F.col("seq").cast("string")))
    x = written(rows.join(found, "seq").withColumn("class", own), "classed")
    held = records.select("id", "title", F.col("repositories"), F.explode("held").alias("p")).select("id", F.col("title").alias("of_title"), "repositories", "p.kind", "p.place")
    held = written(held, "held")
    lacking = held.where("kind = 'multi_field'").groupBy("place", "repositories").agg(F.lit(1).alias("n")).groupBy("place").agg(F.collect_list("repositories").alias("sets"))
    sought = x.select("seq", "class", "sure", "repository", F.explode("sought").alias("p")).select("seq", "class", "sure", "repository", "p.kind", "p.place")
    sought = written(sought, "sought")
    paired = sought.where("kind = 'multi_field' and not sure")
    meets = labelled(paired, lacking, "place", "seq").where(F.exists("sets", lambda s: ~F.array_contains(s, F.col("repository")))).select("seq", "place").distinct()
    paired = paired.join(meets.withColumn("meets", F.lit(True)), ["seq", "place"], "left")
    alike = F.concat(F.lit("p:"), "repository")
    paired = paired.select("seq", F.when(F.col("meets"), F.col("class")).otherwise(F.coalesce(alike, F.col("class"))).alias("class"), "place")
    brought = sought.where("kind = 'multi_field' and sure").select("seq", F.lit("b:").alias("class"), "place")
    touching = written(sought.where("kind <> 'multi_field'").select("seq", "class", "place").unionByName(paired).unionByName(brought), "touching")
    met = labelled(touching, _two_least(touching, "place"), "place", "seq").groupBy("seq").agg(F.max(_earlier()).alias("waits"), F.max(F.col("seq2").isNotNull()).alias("contested"))
    met = written(met, "met")
    waits = met.where("waits").select("seq")

    # records that rows could meet; the two least of other classes of each place are enough
    least = _two_least(touching.where(~F.col("class").startswith("p:") & ~F.col("class").startswith("b:")), "place")
    near = labelled(held, least, "place", "id").select("id", "of_title", F.explode(F.array(F.struct(F.col("seq1").alias("seq"), F.col("class1").alias("class")), F.struct(F.col("seq2").alias("seq"), F.col("class2").alias("class")))).alias("e"))
    bound = x.where("target is not null")
    titles = records.select(F.col("id").alias("target"), F.col("title").alias("of_title"))
    goal = labelled(x.where("sure").select("seq", "class", "target"), titles, "target", "seq").select(F.col("target").alias("id"), "of_title", "seq", "class")
    near = written(near.select("id", "of_title", "e.*").where("seq is not null").unionByName(goal), "near")
    by_record = labelled(bound.select("seq", "class", F.col("target").alias("id")), _two_least(near, "id"), "id", "seq").where(_earlier()).select("seq")
    by_title = near.where("of_title is not null").groupBy(F.col("of_title").alias("title")).agg(F.min("seq").alias("least"))
    open_rows = x.where("title is not null and (target is null or way = 'multi_field')").select("seq", "title")
    # a record that a row is about to become may be widened at once by a row that meets it
    becoming = x.where("not sure and title is not null").select("seq", "title").join(met.where("contested").select("seq"), "seq").groupBy("title").agg(F.min("seq").alias("least"))
    by_title = by_title.unionByName(becoming).groupBy("title").agg(F.min("least").alias("least"))
    beside = labelled(open_rows, by_title, "title", "seq").where("least < seq").select("seq")
    widened = labelled(bound.select("seq", "target"), titles.where("of_title is not null"), "target", "seq")
    unsure = x.where("not sure and title is not null").groupBy(F.col("title").alias("of_title")).agg(F.min("seq").alias("least"))
    widened = labelled(widened, unsure, "of_title", "seq").where("least < seq").select("seq")
    blocked = waits.unionByName(by_record).unionByName(beside).unionByName(widened).distinct()
    return x.join(blocked, "seq", "left_anti").select(*found.columns)


def _listed(v) -> list:
    return [] if v is None else [x for x in v if x is not None]


class _Places:
    """Records by what they have in common with sources: a title and two signals. Asked for the earliest record that has no source of
    a repository and no DOI in the way. Both can only be lost, so what was once passed over is not looked at again."""

    #: Records of a place up to which all are looked at.
    FEW = 16

    def __init__(self, sources: list[dict]) -> None:
        self.records: dict[tuple, list[dict]] = {p: [] for s in sources for p in self.of(s, self.signals(s))}
        self.passed: dict[tuple, dict[tuple, list]] = {}

    @staticmethod
    def signals(r: dict) -> list[tuple]:
        """(number of the signal, value) of a row."""
        one = [(i, r[c]) for i, c in ((1, "participants"), (3, "year")) if r[c] is not None]
        return one + [(i, x) for i, c in ((0, "authors"), (2, "modality")) for x in _listed(r[c])]

    @staticmethod
    def of(r: dict, fresh: list[tuple], known: list[tuple] = ()) -> set[tuple]:
        """The places of a title that ``fresh`` signals make, among themselves and with ``known`` ones."""
        if r["title"] is None:
            return set()
        met = [*combinations(fresh, 2), *((x, y) for x in fresh for y in known)]
        return {(r["title"], min(x, y), max(x, y)) for x, y in met if x[0] != y[0]}

    @staticmethod
    def fits(r: dict, repository: str, own: bool) -> bool:
        return repository not in r["repositories"] and not (own and r["doi"] is not None)

    def enter(self, r: dict, places: set[tuple]) -> None:
        for p in places:
            there = self.records.get(p)
            if there is None:  # no source looks there
                continue
            at = bisect(there, r["created"], key=lambda x: x["created"])
            there.insert(at, r)
            for (repository, own), seen in self.passed.get(p, {}).items():
                if at < seen[0]:
                    seen[0] += 1
                    if self.fits(r, repository, own):
                        heappush(seen[1], (r["created"], r))

    def first(self, s: dict) -> dict | None:
        who = (s["repository"], s["doi"] is not None)
        if who[0] is None:
            return None
        best = None
        for p in self.of(s, self.signals(s)):
            there, at = self.records[p], 0
            if len(there) > self.FEW:
                seen = self.passed.setdefault(p, {}).setdefault(who, [0, []])
                at, late = seen
            while at < len(there) and not self.fits(there[at], *who):
                at += 1
            found = there[at] if at < len(there) else None
            if len(there) > self.FEW:
                seen[0] = at
                while late and not self.fits(late[0][1], *who):
                    heappop(late)
                found = late[0][1] if late else found  # these come before all that are not passed
            if found is not None and (best is None or found["created"] < best["created"]):
                best = found
        return best


def _loop(sources: pa.Table, records: pa.Table) -> pa.Table:
    """(seq, way, target) of sources, one after another, against records that are widened on the way; then the records that were widened or made."""
    index: dict[str, dict] = {c: {} for c in ("doi", "url", "key")}
    incoming = sorted(sources.to_pylist(), key=lambda s: s["seq"])
    places = _Places(incoming)

    def known(r: dict, key: str) -> None:
        index["key"][key] = min(index["key"].get(key, r), r, key=lambda x: x["created"])

    def begin(r: dict, created: tuple, keys: list, repositories: list) -> dict:
        r = {c: r[c] for c in ("id", "doi", "url", "title", *SCALARS)} | {"created": created, "source_keys": dict.fromkeys(_listed(keys)), "repositories": {*_listed(repositories)}, **{c: dict.fromkeys(_listed(r[c])) for c in LISTS}}
        for c in ("doi", "url"):
            if r[c] is not None:
                index[c].setdefault(r[c], r)
        for k in r["source_keys"]:
            known(r, k)
        places.enter(r, places.of(r, places.signals(r)))
        return r

    def widen(r: dict, s: dict) -> None:
        before = places.signals(r)
        if r["doi"] is None and s["doi"] is not None:
            r["doi"] = s["doi"]
            index["doi"].setdefault(s["doi"], r)
        for c in SCALARS:
            r[c] = s[c] if r[c] is None else r[c]
        for c in LISTS:
            r[c] |= dict.fromkeys(_listed(s[c]))
        if s["source_key"] is not None:
            r["source_keys"][s["source_key"]] = None
            known(r, s["source_key"])
        r["repositories"] |= {*_listed([s["repository"]])}
        fresh = places.signals(r)
        if len(fresh) > len(before):
            fresh = list({*fresh} - {*before})
            places.enter(r, places.of(r, fresh, before))

    for r in sorted(records.to_pylist(), key=lambda r: (r["created"], r["id"])):
        begin(r, (r["created"], r["id"]), r["source_keys"], r["repositories"])
    out, touched = [], {}
    for s in incoming:
        def free(r: dict | None, s=s) -> bool:
            return r is not None and (r["doi"] is None or s["doi"] is None or r["doi"] == s["doi"])

        ways = [("doi", index["doi"].get(s["doi"])), *[("cross_reference", index["key"].get(k)) for k in _listed(s["refs"])], ("source_url", index["url"].get(s["url"])), ("source_key", index["key"].get(s["source_key"]))]
        way, target = next(((w, r) for w, r in ways if free(r)), (None, None))
        if target is None:
            target = places.first(s)
            way = "multi_field" if target else None
        out.append({"seq": s["seq"], "way": way, "target": target and target["id"]})
        if target is not None:
            widen(target, s)
        elif s["valid"]:
            target = begin(s, (s["seq"], s["id"]), [s["source_key"]], [s["repository"]])
        if target is not None:
            touched[target["created"]] = target
    for r in touched.values():
        out.append({"record": r | {"created": r["created"][0], "repositories": sorted(r["repositories"]), **{c: list(r[c]) for c in ("source_keys", *LISTS)}}})
    return pa.Table.from_pylist(out, pa.schema([("seq", pa.int64()), ("way", pa.string()), ("target", pa.string()), ("record", pa.struct(records.schema))]))


def _hashes(keys: Column) -> Column:
    """Hashes of a DOI, an address and source keys. Values that share a hash only take a record along that is not needed."""
    one = [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), F.col(c))) for c in ("doi", "url")]
    return F.array_compact(F.concat(F.array(*one), F.transform(keys, lambda k: F.xxhash64(F.lit("key"), k))))


def _pair_hashes() -> Column:
    """As :func:`_pairs`, in 8 bytes."""
    return _pairs(lambda kind, *values: F.xxhash64(F.lit(kind), *[v.cast("string") for v in values]))


def _near(state: DataFrame, part: DataFrame) -> DataFrame:
    """(id) of the records that the sources of a slice could come to, those that they become aside.

    These are all that share a DOI, an address or a key with one of them, and of those that only share a title and two signals, in each place
    and for each set of repositories, with a DOI and without, one more than there are sources of the title: each source shuts one record at most."""
    keys = F.array_distinct(F.array_compact(F.concat(F.coalesce("refs", F.array().cast(STRINGS)), F.array("source_key"))))
    sought = part.select(F.explode(_hashes(keys)).alias("place")).distinct()
    reached = state.select("id", F.explode(_hashes(F.col("source_keys"))).alias("place")).join(sought, "place", "left_semi").select("id").distinct()
    reached = written(reached, "reached")
    titled = part.where("title is not null and repository is not null")
    who = F.struct("repository", F.col("doi").isNotNull().alias("own"))
    titles = titled.groupBy("title").agg(F.count("*").alias("n"), F.collect_set(who).alias("who"))
    looks = titled.select(who.alias("w"), F.explode(_pair_hashes()).alias("place")).groupBy("place").agg(F.collect_set("w").alias("who"))

    def lets_in(who: str) -> Column:
        return F.exists(who, lambda w: ~F.array_contains("repositories", w["repository"]) & (F.col("doi").isNull() | ~w["own"]))

    alike = state.join(titles, "title").where(lets_in("who")).join(reached, "id", "left_anti")
    alike = alike.select("id", "created", "repositories", "doi", "n", F.explode(_pair_hashes()).alias("place")).join(looks, "place").where(lets_in("who"))
    turn = F.row_number().over(Window.partitionBy("place", "repositories", F.col("doi").isNull()).orderBy("created", "id"))
    alike = alike.withColumn("turn", turn).where(F.col("turn") <= F.col("n") + 1)
    near = written(reached.unionByName(alike.select("id").distinct()), "near")
    forget(reached)
    return near


def _slice(state: DataFrame, left: DataFrame, size: int) -> tuple[DataFrame, int, int] | None:
    """(seq, way, target, record) of the earliest of ``left`` by a loop, the last seq among them, and how many they were to be; none where even few could come to too many records."""
    for n in (size >> i for i in range(HALVES)):
        if not n:
            break
        last = left.select("seq").orderBy("seq").limit(n).agg(F.max("seq")).first()[0]
        part = left.where(F.col("seq") <= last)
        met = _near(state, part)
        if met.count() <= LOOP_RECORDS:
            one = F.lit(0).alias("one")
            records = state.join(met, "id", "left_semi")
            done = written(part.groupBy(one).cogroup(records.groupBy(one)).applyInArrow(_loop, _looped(state)), "loop")
            forget(met)
            return done, last, n
        forget(met)
    return None


def _looped(state: DataFrame) -> StructType:
    return StructType().add("seq", "long").add("way", "string").add("target", "string").add("record", state.schema)


def fold(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(seq, id, action, target, via, ambiguous), one row per source.

    ``records``: id, doi, url, title, source_keys, repositories, authors, participants, modality, year; ids are unique, an
    earlier id was created earlier. ``sources``: seq (unique, the order), id (of the record it would become), repository, source_key, doi, url,
    refs (source keys in other repositories), title, authors, participants, modality, year, valid. All keys are normalised.

    A source goes to the record with its DOI, else with the first of its references that is known, else with its address
    (the earliest record that began with it), else with its source key, else to the earliest record of its title with two more signals
    in common that has no source of its repository. Two different DOIs never meet. action: merged, inserted, or invalid for a source that would become
    a record but is not ``valid``. ambiguous: another record of the title was there before. Null keys match nothing.

    Slices are as many as there are LOOP sources, and follow one another. Only where the smallest slice tried could meet more than LOOP_RECORDS records
    are there rounds; of a chain of sources of several repositories that all share title and signals each takes one then."""
    columns = ["seq", "id", "repository", "source_key", "doi", "url", "refs", "title", "authors", "participants", "modality", "year", "valid"]
    sources = written(sources.select(*[F.col(c).cast(STRINGS).alias(c) if c in (*LISTS, "refs") else F.col(c) for c in columns]), "sources")
    wide = records.select(*SCALARS).unionByName(sources.select(*SCALARS)).schema
    records = records.withColumns({c: F.col(c).cast(wide[c].dataType) for c in SCALARS})
    # the records with all decided before ``since``; rounds decide out of order, so after one nothing is added up
    base = state = written(_state(records, None), "state")
    left, since, size = sources, None, LOOP
    parts: list[DataFrame] = []
    tables: list[DataFrame] = []

    def decide(rows: DataFrame, found: DataFrame) -> DataFrame:
        action = F.when(F.col("target").isNotNull(), "merged").when(F.coalesce("valid", F.lit(False)), "inserted").otherwise("invalid")
        return rows.join(found, "seq").withColumn("action", action).withColumn("target", F.when(action == "inserted", F.col("id")).otherwise(F.col("target")))

    while not left.isEmpty():
        cut = _slice(state, left, size)
        if cut is None:
            held, rows = written(state.withColumn("held", _held()), "held"), written(left.withColumn("sought", _sought()), "sought")
            found = written(_found(held, rows), "found")
            ready = written(_ready(held, rows, found).select("seq", "way", "target"), "ready")
            forget(held, rows, found)
            rest = written(left.join(ready.select("seq"), "seq", "left_anti"), "left")
            if left is not sources:
                forget(left)
            left = rest
        else:
            done, last, n = cut
            ready = done.where("seq is not null").select("seq", "way", "target")
            left = left.where(F.col("seq") > last)
            size = min(LOOP, 2 * n)
        if cut is None or since is not None:
            now = decide(sources, ready)
            since = written(now if since is None else since.unionByName(now), "since")
            after = _state(base, since)
        else:
            changed = done.where("record is not null").select("record.*")
            after = state.join(changed.select("id"), "id", "left_anti").unionByName(changed)
        after = written(after, "state")
        if state is not base or since is None:
            forget(state)
        state = after
        base = base if since is not None else state
        parts.append(ready)
        tables.append(ready if cut is None else done)
        if len(parts) > 8:  # plans stay short
            parts = [written(reduce(DataFrame.unionByName, parts), "decided")]
            forget(*tables)
            tables = [*parts]
    if not parts:
        return sources.select("seq", "id", F.lit(None).cast("string").alias("action"), F.col("id").alias("target"), F.lit(None).cast("string").alias("via"), F.lit(False).alias("ambiguous"))
    decided = written(decide(sources.select("seq", "id", "title", "valid"), reduce(DataFrame.unionByName, parts)), "decided")
    forget(base, state, *tables)
    # the two earliest records of each title tell whether another one was there
    began = records.select("title", F.struct(F.lit(-1).cast("long").alias("created"), "id").alias("r"))
    began = began.unionByName(decided.where("action = 'inserted'").select("title", F.struct(F.col("seq").alias("created"), "id").alias("r"))).where("title is not null")
    first = began.groupBy("title").agg(F.min("r").alias("one"))
    second = labelled(began.withColumn("by", F.col("r.id")), first, "title", "by").where("r <> one").groupBy("title").agg(F.min("r").alias("two"))
    both = written(first.join(second, "title", "left"), "titles")
    other = F.when(F.col("one.id") == F.col("target"), F.col("two.created")).otherwise(F.col("one.created"))
    titled = labelled(decided.where("title is not null"), both, "title", "seq").where(F.coalesce(F.when(F.col("target").isNull(), F.col("one.created")).otherwise(other) < F.col("seq"), F.lit(False))).select("seq", F.lit(True).alias("ambiguous"))
    out = decided.join(titled, "seq", "left")
    via = F.when(F.col("action") == "merged", F.col("way")).when(F.col("action") == "inserted", "new")
    return out.select("seq", "id", "action", "target", via.alias("via"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))
