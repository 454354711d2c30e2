"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a path is content-addressed: its blob is the SHA-256 of its text. A ledger
below a folder holds the ``(blob, rule, version)`` triples scanned so far and their findings.
A run scans only blobs with a pair that is not in the ledger, each blob once however many paths
have it, only with the rules that are new to it, and appends its own folder to the ledger. The
findings of all runs are then joined back to every path.

A rule is a pattern, the least length of one of its groups, and a version that is raised when
either changes. Matches are leftmost and do not overlap within a rule; those that are too short
are dropped after matching. Offsets count code points, ends are exclusive.

Defined results: a null text is an empty blob without findings. Repeated rows and null ids keep
their own rows. An empty table gives an empty result, a rerun over the same rows scans nothing.
Only the given path columns and the text are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm.common import read_table, scratch

FINDINGS = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1


# The base rules.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12, group=2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)

#: Spans that the method adds to the base ones.
MORE_RULES = (
    Rule("private", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 20),
)

RULES = BASE_RULES + MORE_RULES


def _spans(text: Column, rule: Rule) -> Column:
    """Start and end of every match that is long enough.

    The pieces between matches and the matches themselves come from the same pattern, so the
    running total of their lengths gives the places.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    inner = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("between"), whole.alias("match"), inner.alias("inner")
    )
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found")
    )

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.char_length(x["between"])
        end = begin + F.coalesce(F.char_length(x["match"]), F.lit(0))
        hit = F.coalesce(F.char_length(x["inner"]) >= rule.least, F.lit(False))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(hit, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    found = F.aggregate(steps, start, step, lambda state: state["found"])
    return F.when(F.regexp_like(text, pattern), found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def blob(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All findings so far, one row per scanned blob, rule and version; none before the first run."""
    try:
        return spark.read.schema(FINDINGS).option("recursiveFileLookup", "true").parquet(f"{ledger}/findings")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FINDINGS)


def scan_new(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger does not hold yet and append it, one folder per run."""
    spark = versions.sparkSession
    wanted = F.array(*[F.concat_ws("@", F.lit(r.kind), F.lit(str(r.version))) for r in rules])
    seen = (
        _ledger(spark, ledger).groupBy("blob")
        .agg(F.collect_set(F.concat_ws("@", "kind", F.col("version").cast("string"))).alias("seen"))
    )
    # One text per blob: copies are dropped within each task before anything is shuffled.
    blobs = versions.select(blob().alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    todo = (
        blobs.join(seen, "blob", "left")
        .withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        .filter(F.size("todo") > 0)
    )
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    scanned = todo.select(
        "blob",
        *[
            F.when(F.array_contains("todo", f"{r.kind}@{r.version}"), _spans(F.col("text"), r)).otherwise(none).alias(r.kind)
            for r in rules
        ],
    )
    cells = F.array(*[
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(r.kind).alias("spans")) for r in rules
    ])
    (
        scanned.select("blob", F.inline(cells)).filter("spans is not null")
        .write.parquet(f"{ledger}/findings/run={uuid4().hex}")
    )


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` without their text, with ``found``: all spans ``(start, kind number, kind, end)``
    in order, for the current versions of the rules."""
    current = reduce(
        lambda a, b: a | b, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules]
    )
    number = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)])
    by_blob = (
        _ledger(versions.sparkSession, ledger).filter(current & (F.size("spans") > 0))
        .withColumn("number", number)
        .select("blob", F.transform(
            "spans", lambda s: F.struct(s["start"].alias("start"), F.col("number"), F.col("kind"), s["end"].alias("end"))
        ).alias("own"))
        .groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("__found"))
        .withColumnRenamed("blob", "__blob")
    )
    paths = [F.col(f"`{c}`") for c in versions.columns if c not in ("text", "found")]
    kind = "array<struct<start:int,number:int,kind:string,end:int>>"
    return versions.select(*paths, blob().alias("__of")).join(by_blob, F.col("__of") == F.col("__blob"), "left").select(
        *paths, F.coalesce("__found", F.array().cast(kind)).alias("found")
    )


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with ``versions`` (path columns and ``text``); return all findings."""
    scan_new(versions, ledger, rules)
    return findings(versions, ledger, rules)


def joined(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_versions(docs, scratch(spark, "secret-ledger"))
    base = F.filter("found", lambda s: s["number"] < len(BASE_RULES))

    def number_of(rule: int) -> Column:
        return F.size(F.filter("found", lambda s: s["number"] == rule)).cast("long")

    return found.select(
        "doc_id",
        *[number_of(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )
