"""Secret scans with an incremental blob ledger.

Every text is a blob named by its SHA-256, however many paths or versions hold it. The ledger, a Parquet table, keeps the
spans that each rule version found in each blob, empty ones too. A scan reads only the blobs for which some rule version is
missing, runs just the missing rules, appends to the ledger, and joins the ledger back to all paths. A changed pattern is a
new rule version. No Python runs on executors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.llm.quality import let, text_of
from fieldpulse.session import scratch

LEDGER = "rule string, blob binary, spans array<struct<start:int,end:int>>"
_NONE = "array<struct<start:int,end:int>>"
_BLOCK = 256


@dataclass(frozen=True)
class SecretRule:
    """Matches of ``pattern``, leftmost and not overlapping; those whose group is too short are dropped afterwards.

    ``marker`` is a string that every match holds; texts without it are not searched.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    marker: str | None = None

    @property
    def version(self) -> str:
        what = f"{self.pattern}\n{self.group}\n{self.least}"
        return f"{self.kind}@{hashlib.sha256(what.encode()).hexdigest()[:12]}"


#: Base kinds first, in their order. Runs of one class match from their start to their end, so the least length of a
#: whole match can stand in the pattern (hex, access); for assignments a short value uses up its place and is dropped.
RULES = [
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               group=2, least=6),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}", marker="AKIA"),
    SecretRule("hex", r"[0-9a-f]{24,}"),
    SecretRule("private_key", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", marker="PRIVATE KEY-----"),
    SecretRule("host_token", r"gh[pousr]_[A-Za-z0-9]{36,}", marker="gh"),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", marker="xox"),
    SecretRule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", marker="eyJ"),
]
BASE = ("assign", "access", "hex")


def running_sums(numbers: Column) -> Column:
    """Inclusive running sums of an array of ints, in blocks so that the work stays linear."""
    zero = F.array(F.lit(0))

    def sums(x: Column, start: Column) -> Column:
        return F.aggregate(x, F.array(start), lambda got, v: F.array_append(got, F.element_at(got, -1) + v))

    def joined(blocks: Column) -> Column:
        offsets = F.aggregate(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda t, v: t + v)), zero,
                              lambda got, v: F.array_append(got, F.element_at(got, -1) + v))
        return let(offsets, lambda o: F.flatten(F.transform(
            blocks, lambda b, i: F.slice(sums(b, F.get(o, i)), F.lit(2), F.size(b)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _BLOCK).cast("int")),
                         lambda k: F.slice(numbers, k * _BLOCK + 1, F.lit(_BLOCK)))
    return F.when(F.size(numbers) == 0, F.array().cast("array<int>")).otherwise(let(blocks, joined))


def spans(text: Column, rule: SecretRule) -> Column:
    """Start and end (exclusive) of each match, in code points: texts between matches and matches alternate."""
    pattern = F.lit(rule.pattern)

    def placed(hits: Column, gaps: Column) -> Column:
        ends = running_sums(F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i))))
        found = let(ends, lambda e: F.transform(hits, lambda h, i: F.struct(
            (F.get(e, i) - F.length(h)).alias("start"), F.get(e, i).alias("end"),
            (F.length(F.regexp_extract(h, rule.pattern, rule.group)) >= rule.least).alias("ok"))))
        return F.transform(F.filter(found, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    search = let(F.regexp_extract_all(text, pattern, F.lit(0)),
                 lambda hits: let(F.split(text, rule.pattern, -1), lambda gaps: placed(hits, gaps)))
    possible = text.rlike(rule.pattern)
    if rule.marker:
        possible = F.contains(text, F.lit(rule.marker)) & possible
    return F.when(possible, search).otherwise(F.array().cast(_NONE))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The stored findings; none before the first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def update_ledger(docs: DataFrame, path: str, rules: list[SecretRule], key: str = "doc_id", text: str = "text") -> None:
    """Scan what the ledger lacks for the texts of ``docs`` and append it."""
    spark = docs.sparkSession
    versions = [r.version for r in rules]
    rows = docs.select(F.unhex(F.sha2(text_of(text), 256)).alias("blob"), F.col(key).alias("id"), text_of(text).alias("body"))
    known = read_ledger(spark, path).where(F.col("rule").isin(versions)).groupBy("blob").agg(
        F.collect_set("rule").alias("seen"))
    blobs = rows.groupBy("blob").agg(F.min("id").alias("one"))
    every = F.array(*[F.lit(v) for v in versions])
    todo = blobs.join(known, "blob", "left").withColumn("todo", F.when(F.col("seen").isNull(), every).otherwise(
        F.array_except(every, F.col("seen")))).where(F.size("todo") > 0).select(
        F.col("blob").alias("b"), "one", "todo")
    texts = rows.join(todo, (F.col("blob") == F.col("b")) & F.col("id").eqNullSafe(F.col("one")))
    found = F.array(*[F.struct(F.lit(r.version).alias("rule"), F.when(
        F.array_contains("todo", r.version), spans(F.col("body"), r)).alias("spans")) for r in rules])
    fresh = texts.select("blob", F.explode(F.filter(found, lambda x: x["spans"].isNotNull())).alias("f"))
    fresh.select("f.rule", "blob", "f.spans").write.mode("append").parquet(path)


def scan(docs: DataFrame, ledger: str | None = None, rules: list[SecretRule] | None = None, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """One row per input row: key and ``spans``, an array of (kind, start, end) by start, then kind in rule order.

    ``ledger`` is a folder that all executors share and that outlives the session; without one, a new folder is used. Null
    and empty texts are one blob without findings. Paths with equal text share its findings; a null key is a path like any
    other; repeated rows are returned as often as they come. Other columns are ignored.
    """
    rules = RULES if rules is None else rules
    spark = docs.sparkSession
    path = ledger or scratch(spark, "ledger")
    update_ledger(docs, path, rules, key, text)
    order = {r.version: (i, r.kind) for i, r in enumerate(rules)}
    place = F.create_map(*[F.lit(x) for v, (i, _) in order.items() for x in (v, i)])
    kind = F.create_map(*[F.lit(x) for v, (_, k) in order.items() for x in (v, k)])
    hits = read_ledger(spark, path).where(F.col("rule").isin(list(order)) & (F.size("spans") > 0)).dropDuplicates(
        ["rule", "blob"]).groupBy("blob").agg(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(
            s["start"].alias("start"), place[F.col("rule")].alias("place"), s["end"].alias("end"),
            kind[F.col("rule")].alias("kind"))))).alias("found"))
    listed = F.transform(F.sort_array("found"), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    paths = docs.select(F.unhex(F.sha2(text_of(text), 256)).alias("blob"), F.col(key))
    return paths.join(hits.select("blob", listed.alias("spans")), "blob", "left").select(
        key, F.coalesce("spans", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("spans"))


def listing(found: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Spans as kind:start:end, comma-joined, of some kinds or all."""
    if kinds is not None:
        found = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
