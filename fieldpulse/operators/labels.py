"""Failure labels: routing journal claims and resolving them to catalogued objects.

Resolution works on distinct (number, district) pairs and on one representative per (number, district) of the
catalogue, so neither repeated claims nor repeated numbers multiply. Every join is an equality:

* a district is contained in a municipality name: the municipality offers all its substrings as keys;
* numbers are equal: score 100, the best there is;
* numbers are similar: both sides offer what is left after deleting a few characters. Two strings whose
  insert/delete distance is d share such a remainder with d deletions in total, so every pair that meets within the
  limit is a true match and a string meets only the strings within that distance. Long names, whose allowed distance
  would make deletions too many, meet on one of their parts that carries few of the edits, and are then measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldpulse.functions.deletions import Kind, meetings
from fieldpulse.functions.text import clean_district, extract_plant, norm_number, usable_extraction, with_indel_ratio
from fieldpulse.functions.values import finite
from fieldpulse.operators.cleaning import pick_row
from fieldpulse.schemas import FUZZY_THRESHOLD, LABEL_SOURCE, NOT_FOUND, PLANT_TYPE
from fieldpulse.session import cut_lineage
from fieldpulse.sources.landing import ORIGIN


def route_journal(journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plant incidents, other events): last row per claim, text and opening time present."""
    order = [c for c in ORIGIN if c in journal.columns] or ["source_file"]
    latest = pick_row(journal, ["id_cds_claim"], order, last=True)
    usable = latest.dropna(subset=["text_message", "d_create"])
    other = (F.col("obj_koteln") | F.col("obj_ts")) & ~F.col("obj_ctp")
    return usable.where("obj_ctp"), usable.where(other)


def eligible_catalog(objects: DataFrame, kind: str = PLANT_TYPE) -> DataFrame:
    """Objects a claim may refer to: the right type, named and placed."""
    return objects.where((F.col("facility_type") == kind) & (F.col("facility_name") != "")
                         & (F.col("municipality") != "")).select("object_id", "facility_name", "municipality")


def _substrings(text: Column) -> Column:
    """All distinct non-empty substrings of a short text."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), n)
    pieces = F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), n - i + 1), lambda size: F.substr(text, i, size))))
    return F.when(n > 0, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def district_places(districts: DataFrame, catalog: DataFrame) -> DataFrame:
    """(district, place) pairs where the place's name contains the district's, both lower case."""
    places = catalog.select(F.lower("municipality").alias("place")).distinct()
    offered = places.select("place", F.explode(_substrings(F.col("place"))).alias("district"))
    return districts.select("district").distinct().where(F.col("district") != "").join(offered, "district")


def _without(text: Column, deletions: int) -> Column:
    """Every string left after deleting exactly ``deletions`` characters."""
    left = F.array(text)
    for _ in range(deletions):
        left = F.array_distinct(F.flatten(F.transform(left, lambda s: F.when(F.length(s) > 0, F.transform(
            F.sequence(F.lit(1), F.length(s)),
            lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1, F.length(s))),
        )).otherwise(F.array().cast("array<string>")))))
    return left


def _remainders(text: Column, most: int, allowed: Column) -> Column:
    """Array of {rest, cut}: what is left of a text after up to ``allowed`` (at most ``most``) deletions."""
    none = F.array().cast("array<struct<rest:string,cut:int>>")

    def after(cuts: int) -> Column:
        tagged = F.transform(_without(text, cuts), lambda s: F.struct(s.alias("rest"), F.lit(cuts).alias("cut")))
        return F.when(allowed >= cuts, tagged).otherwise(none)

    return F.flatten(F.array(*[after(cuts) for cuts in range(most + 1)]))


def allowed_distance(total: Column, threshold: int) -> Column:
    """Most insertions and deletions two strings of this total length may be apart."""
    return F.floor(total * (100 - threshold) / 100 + 1e-9).cast("int")


def _lengths(df: DataFrame, c: str) -> DataFrame:
    """Distinct string lengths as one array: no longer than the longest name."""
    return df.agg(F.array_sort(F.collect_set(F.length(c))))


def _length_pairs(queries: DataFrame, names: DataFrame, threshold: int) -> list[tuple[int, int, int]]:
    """(query's length, name's length, allowed distance) of all that occur and may be near enough: no rows, only lengths."""
    mine, theirs = (_lengths(df, c).first()[0] for df, c in ((queries, "query"), (names, "name")))
    pairs = ((q, n, int((q + n) * (100 - threshold) / 100 + 1e-9)) for q in mine for n in theirs)
    return [(q, n, limit) for q, n, limit in pairs if limit >= max(1, abs(q - n))]


def _pairs_by_deletion(queries: DataFrame, names: DataFrame, threshold: int, lengths: list[tuple[int, int, int]]) -> DataFrame:
    """Pairs of the given lengths.

    Of d edits between lengths q and n exactly (d + q - n) / 2 delete from the query, and two strings that share a rest
    share shorter ones too: for each pair of lengths both sides offer the rests of one length, that of the farthest pair.
    Rests go as marks past filters of bounded size, so that only marks that both sides have are written and shuffled.
    """
    kinds = []
    for number, (q, n, limit) in enumerate(lengths):
        d = limit - (limit - q + n) % 2
        if d >= 1:
            kinds.append((Kind(number, q, (d + q - n) // 2), Kind(number, n, (d - q + n) // 2)))
    found = queries.sparkSession.createDataFrame([], "query string, name string, score double")
    for met in meetings(queries, names, kinds):
        found = found.unionByName(cut_lineage(_measured(met, threshold)))
    return found


def _measured(met: DataFrame, threshold: int) -> DataFrame:
    """Candidates that are similar enough; the ordinary edit distance, which is never larger, sorts out most others."""
    limit = allowed_distance(F.length("query") + F.length("name"), threshold)
    near = met.where(F.levenshtein("query", "name") <= limit)
    return with_indel_ratio(near.select("query", "name")).where(F.col("score") >= threshold)


PART_EDITS = 2
SPREAD = 4096  # tasks that claims without a usable name can keep busy


def _pairs_by_part(queries: DataFrame, names: DataFrame, threshold: int, beyond: int) -> DataFrame:
    """Pairs whose allowed distance exceeds ``beyond``.

    The name is cut into so many parts that one of them carries at most two of the edits: that part and some stretch
    of the query, at most d places away, share what is left after two deletions in all. Whoever meets that way is
    measured, after the ordinary edit distance (never larger than insertions plus deletions) has sorted out the rest.
    """
    def partners(df: DataFrame, c: str, other: DataFrame, o: str) -> DataFrame:
        mine = F.length(c)

        def reach(n: Column) -> Column:
            limit = allowed_distance(mine + n, threshold)
            return F.when((limit > beyond) & (F.abs(mine - n) <= limit), limit).otherwise(F.lit(0))

        rows = df.withColumn("_lens", _lengths(other, o).scalar())
        return rows.withColumn("_reach", F.array_max(F.transform("_lens", reach))).where("_reach > 0").drop("_lens")

    n, m = F.length("name"), F.length("query")
    parts = F.floor(F.col("_reach") / (PART_EDITS + 1)).cast("int") + 1
    cut_names = partners(names, "name", queries, "query").withColumn("_k", parts)
    cut = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda i: F.struct(
        (F.floor(i * n / F.col("_k")) + 1).cast("int").alias("at"),
        (F.floor((i + 1) * n / F.col("_k")) - F.floor(i * n / F.col("_k"))).cast("int").alias("size")))
    pieces = cut_names.select("name", F.explode(cut).alias("_p")).select(
        "name", F.col("_p.at").alias("_at"), F.col("_p.size").alias("_size"),
        F.substr(F.col("name"), F.col("_p.at"), F.col("_p.size")).alias("part"))
    name_keys = pieces.select("name", "_at", F.explode(_remainders(F.col("part"), PART_EDITS, F.lit(PART_EDITS))).alias(
        "_v")).select("name", "_at", F.col("_v.rest").alias("rest"), F.col("_v.cut").alias("_j"))

    sizes = pieces.agg(F.array_sort(F.collect_set("_size")))
    asked = partners(queries, "query", names, "name").withColumn("_sizes", sizes.scalar()).where("size(_sizes) > 0")
    shortest = F.greatest(F.array_min("_sizes") - PART_EDITS, F.lit(1))
    longest = F.array_max("_sizes") + PART_EDITS
    stretches = F.flatten(F.transform(F.sequence(F.lit(1), m), lambda i: F.transform(
        F.filter(F.sequence(shortest, longest), lambda size: size <= m - i + 1),
        lambda size: F.struct(i.alias("at"), F.substr(F.col("query"), i, size).alias("part")))))
    query_keys = asked.select("query", F.explode(stretches).alias("_s")).select(
        "query", F.col("_s.at").alias("_from"),
        F.explode(_remainders(F.col("_s.part"), PART_EDITS, F.lit(PART_EDITS))).alias("_v")).select(
        "query", "_from", F.col("_v.rest").alias("rest"), F.col("_v.cut").alias("_i"))

    limit = allowed_distance(m + n, threshold)
    # merged: the planner takes the keys for as small as the strings they were made of, and would broadcast them
    met = query_keys.hint("merge").join(name_keys, "rest").where(
        (F.col("_i") + F.col("_j") <= PART_EDITS) & (limit > beyond) & (F.abs(m - n) <= limit)
        & (F.abs(F.col("_from") - F.col("_at")) <= limit)).select("query", "name").distinct()
    return _measured(met, threshold)


def similar_pairs(queries: DataFrame, names: DataFrame, threshold: int = FUZZY_THRESHOLD,
                  deletions: int = 4, longest: int | None = None) -> DataFrame:
    """(query, name, score) for all distinct pairs that differ and score at least ``threshold``.

    A caller that knows the length of its longest query and name together (``longest``) saves the searches for
    distances that no pair can have.
    """
    queries = queries.select("query").where(F.col("query").isNotNull()).distinct()
    names = names.select("name").where(F.col("name").isNotNull()).distinct()
    farthest = None if longest is None else int(longest * (100 - threshold) / 100 + 1e-9)
    lengths = [pair for pair in _length_pairs(queries, names, threshold) if farthest is None or pair[2] <= farthest]
    pairs = _pairs_by_deletion(queries, names, threshold, [pair for pair in lengths if pair[2] <= deletions])
    if any(pair[2] > deletions for pair in lengths):
        pairs = pairs.unionByName(_pairs_by_part(queries, names, threshold, deletions))
    return pairs.where(F.col("query") != F.col("name"))


def match_catalog(claims: DataFrame, catalog: DataFrame, threshold: int = FUZZY_THRESHOLD,
                  extracted: str = "extracted", district: str = "name_mr") -> DataFrame:
    """Best catalogue row per claim: inside its district when any place carries that name, else anywhere.

    Adds ``object_id``, ``matched_name``, ``place`` and ``score`` (NULL when nothing reaches the threshold). Of equal
    scores the smallest object id wins. The distinct pairs, the catalogue's names, the equal matches and what they leave
    over are written once: every kind of match reads them.
    """
    def keys(df: DataFrame) -> DataFrame:
        return df.withColumns({"_query": norm_number(usable_extraction(extracted)),
                               "_district": F.lower(F.coalesce(clean_district(district), F.lit("")))})

    # spellings are few: they are collapsed before they are normalised, and names without a number are left out of the
    # written table only, since a filter would move below and normalise every claim
    spelled = keys(claims.select(extracted, district).distinct())
    pairs = cut_lineage(spelled.select(F.col("_query").alias("query"), F.col("_district").alias("district")).distinct())
    pairs = pairs.where(F.col("query").isNotNull())
    placed = cut_lineage(catalog.select(
        "object_id", "facility_name", "municipality", norm_number("facility_name").alias("name"),
        F.lower("municipality").alias("place_key")))
    # one representative per number and place, and one per number
    first = F.min(F.struct("object_id", "facility_name", "municipality")).alias("row")
    by_place = placed.groupBy("name", "place_key").agg(first)
    anywhere = placed.groupBy("name").agg(first)

    places = district_places(pairs, catalog)
    inside = pairs.join(places, "district").withColumnRenamed("place", "place_key")
    outside = pairs.join(places.select("district").distinct(), "district", "left_anti")

    def best(candidates: DataFrame, inner: DataFrame, outer: DataFrame) -> DataFrame:
        """The best row per pair: ``inner`` pairs look inside their places, ``outer`` ones anywhere."""
        top = F.min(F.struct((-F.col("score")).alias("minus"), F.col("row.object_id").alias("id"), "row"))
        local = inner.join(candidates, "query").join(by_place, ["name", "place_key"])
        wide = outer.join(candidates, "query").join(anywhere, "name")
        both = local.select("query", "district", "score", "row").unionByName(
            wide.select("query", "district", "score", "row"))
        return both.groupBy("query", "district").agg(top.alias("top"))

    # an equal number is the best there can be: only pairs without one go on to the similar names
    equal = pairs.select("query").distinct().select("query", F.col("query").alias("name"), F.lit(100.0).alias("score"))
    found = cut_lineage(best(equal, inside, outside))
    left = cut_lineage(pairs.join(found, ["query", "district"], "left_anti"))
    # one number per side: NULL when there is nothing to compare
    longest = left.agg(F.max(F.length("query")).alias("n")).withColumn(
        "n", F.col("n") + placed.agg(F.max(F.length("name"))).scalar()).first()["n"]
    if longest is not None and longest * (100 - threshold) >= 100:
        similar = cut_lineage(similar_pairs(left, placed, threshold, longest=longest))
        found = found.unionByName(best(similar, inside.join(left, ["query", "district"], "left_semi"),
                                       outside.join(left, ["query", "district"], "left_semi")))
    found = found.select(
        F.col("query").alias("_query"), F.col("district").alias("_district"),
        F.col("top.row.object_id").alias("object_id"), F.col("top.row.facility_name").alias("matched_name"),
        F.col("top.row.municipality").alias("place"), (-F.col("top.minus")).alias("score"))
    # a claim without a usable name matches nothing; such claims spread over all tasks of the join instead of one
    spread = F.pmod(F.xxhash64(*claims.columns), F.lit(SPREAD)).cast("string")
    asked = keys(claims).withColumn("_district", F.when(F.col("_query").isNull(), spread).otherwise(F.col("_district")))
    return asked.join(found, ["_query", "_district"], "left").drop("_query", "_district")


def resolve(claims: DataFrame, cache: DataFrame, catalog: DataFrame, threshold: int = FUZZY_THRESHOLD,
            extraction: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(resolutions of all claims, rows to append to the cache). A claim found in the cache is never resolved again.

    ``extraction`` computes the plant's name from a claim; by default its first mention in the text.
    """
    known = claims.select(F.col("id_cds_claim").alias("claim_id")).join(cache, "claim_id")
    # written before anything is extracted: the planner would otherwise move filters on the extraction below the join
    todo = cut_lineage(claims.join(cache.select(F.col("claim_id").alias("id_cds_claim")), "id_cds_claim", "left_anti"))
    named = todo.withColumn("extracted", extract_plant("text_message") if extraction is None else extraction)
    fresh = match_catalog(named, catalog, threshold).select(
        F.col("id_cds_claim").alias("claim_id"), "object_id", "extracted",
        F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(None).cast("string").alias("error"))
    return known.select(*fresh.columns).unionByName(fresh), fresh


def to_incidents(claims: DataFrame, resolved: DataFrame, source: str = LABEL_SOURCE) -> DataFrame:
    """Publishable labels: resolved claims with an opening time."""
    rows = resolved.where(F.col("object_id").isNotNull()).select(F.col("claim_id").alias("id_cds_claim"), "object_id")
    return claims.where(F.col("d_create").isNotNull()).join(rows, "id_cds_claim").select(
        F.col("id_cds_claim").cast("string").alias("incident_id"), "object_id",
        F.unix_timestamp("d_create").alias("incident_ts"), F.unix_timestamp("d_close").alias("close_ts"),
        F.lit(source).alias("source"))


def label_stats(incidents: DataFrame, other: DataFrame, resolved: DataFrame, published: DataFrame,
                duplicates: DataFrame | None = None) -> DataFrame:
    """The label funnel as one row."""
    def rows(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"))

    named = F.coalesce(F.lower(F.trim("extracted")) != NOT_FOUND, F.lit(False))
    funnel = resolved.agg(F.count_if(named).alias("llm_extracted"), F.count("object_id").alias("resolved"))
    out = incidents.agg(F.count(F.lit(1)).alias("incidents_ctp"), F.min("d_create").alias("period_from"),
                        F.max("d_create").alias("period_to"))
    skipped = F.lit(0).cast("bigint") if duplicates is None else rows(duplicates).scalar()
    out = out.withColumns({
        "go_events": rows(other).scalar(),
        "llm_extracted": funnel.select("llm_extracted").scalar(),
        "resolved": funnel.select("resolved").scalar(),
        "published": rows(published).scalar(), "duplicates": skipped})
    return out.withColumn("unresolved", F.col("incidents_ctp") - F.col("resolved"))


def label_parity(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, differing rows) of two label sets with ``claim_id`` and ``object_id``."""
    left = a.select("claim_id", F.col("object_id").alias("object_a"))
    right = b.select("claim_id", F.col("object_id").alias("object_b"))
    x, y = F.col("object_a"), F.col("object_b")
    verdict = (F.when(x.isNull() & y.isNull(), "both_unresolved").when(y.isNull(), "only_a")
               .when(x.isNull(), "only_b").when(x == y, "agree").otherwise("disagree"))
    joined = left.join(right, "claim_id", "full_outer").withColumn("verdict", verdict)
    kinds = ["agree", "both_unresolved", "disagree", "only_a", "only_b"]
    report = joined.agg(*[F.count_if(F.col("verdict") == k).alias(k) for k in kinds],
                        F.count("object_a").alias("resolved_a"), F.count("object_b").alias("resolved_b"))
    report = report.withColumn("agreement", finite(F.col("agree") / F.greatest(F.col("resolved_b"), F.lit(1))))
    return report, joined.where(F.col("verdict").isin("disagree", "only_a", "only_b"))
