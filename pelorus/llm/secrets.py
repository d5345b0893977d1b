"""Secret scans with an incremental ledger of blobs. DataFrame functions only.

Every version of every file is content-addressed by the SHA-256 of its text.
The ledger remembers which (blob, rule version) pairs were scanned and what
was found; a scan looks only at pairs the ledger lacks, adds them, and joins
the findings back to every path that holds the blob. A blob that lies at a
million paths is scanned once.

Places of matches come out of the text itself: splitting at a rule's matches
gives the gaps between them, and the running sum of gap and match lengths
gives each match's start in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelorus.session import shared_folder


@dataclass(frozen=True)
class Rule:
    """A match counts if its ``group`` has ``least`` characters; ``version`` grows when a rule changes."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    base: bool = False


# The base rules, then rules for credentials of well-known shapes.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, base=True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, base=True),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
)
RULES = BASE_RULES + MORE_RULES

#: Matches of a text whose places are summed up together.
BLOCK = 256

SPANS = "array<struct<start:int,rank:int,kind:string,end:int,base:boolean>>"


def rules_version(rules: tuple[Rule, ...] = RULES) -> str:
    """Names the set of rules with their versions and patterns."""
    import hashlib

    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's leftmost non-overlapping matches that are long enough."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    gaps = F.split(text, rule.pattern, -1)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), matches.alias("all"), parts.alias("part"))
    empty = F.array().cast(SPANS)
    # places are summed up in blocks, so that the copies that an array's growth costs stay short
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")), lambda b: F.slice(zipped, b * BLOCK + 1, F.lit(BLOCK)))
    lengths = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["all"])))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    places = F.aggregate(lengths, begin, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["all"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"), F.lit(rule.base).alias("base"))
        long_enough = F.length(x["part"]) >= rule.least
        return F.struct(end.alias("at"), F.when(long_enough, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    found = F.zip_with(blocks, places, lambda xs, at: F.aggregate(xs, F.struct(at.alias("at"), empty.alias("found")), step)["found"])
    return F.when(text.rlike(rule.pattern), F.flatten(found)).otherwise(empty)


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then rule; null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[rule_spans(text, r, i) for i, r in enumerate(rules)]))


class Ledger:
    """Table of scanned (blob, rules_version) with their spans, at ``path``; created when first written."""

    SCHEMA = f"blob string, rules_version string, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        """What was scanned so far."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def add(self, scanned: DataFrame) -> None:
        scanned.write.mode("append").option("compression", "zstd").parquet(self.path)


def new_ledger(spark: SparkSession) -> Ledger:
    """An empty ledger in the shared folder."""
    import uuid

    return Ledger(spark, f"{shared_folder(spark)}/pelorus-ledger-{uuid.uuid4().hex}")


def scan(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, content: str = "text", into: str = "spans") -> DataFrame:
    """Add the spans, as column ``into``, to every row of ``versions``, scanning only what the ledger lacks.

    Blobs are told apart by hash, and one text for each is gathered with
    partial aggregation, so that copies are dropped before anything moves.
    Null content counts as empty; an empty table gives no rows and leaves the
    ledger as it is; repeated rows share a blob. A blob that two scans at once
    have added counts once.
    """
    version = rules_version(rules)
    text = F.coalesce(F.col(content), F.lit(""))
    addressed = versions.withColumn("__blob", F.sha2(text, 256))
    done = ledger.table().where(F.col("rules_version") == version).select("blob")
    blobs = addressed.select(F.col("__blob").alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    unseen = blobs.join(done, "blob", "left_anti")
    ledger.add(unseen.select("blob", F.lit(version).alias("rules_version"), find_spans(F.col("text"), rules).alias("spans")))
    found = ledger.table().where((F.col("rules_version") == version) & (F.size("spans") > 0)).groupBy(F.col("blob").alias("__blob")).agg(F.first("spans").alias("__spans"))
    out = addressed.join(found, "__blob", "left")
    return out.withColumn(into, F.coalesce("__spans", F.array().cast(SPANS))).select(*versions.columns, into)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], kept).otherwise(state["out"]).alias("out"))

    def end(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)


def without_secrets(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span masked in ``text``; n_chars, if there, is the new length.

    All rows stay, null texts as they are.
    """
    found = scan(docs, ledger, rules, into="__found")
    out = found.withColumn("text", redacted(F.col("text"), F.col("__found"))).drop("__found")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
