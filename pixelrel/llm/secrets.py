"""Secret spans by regular expression, with weak parts reported only when complementary parts lie near.

Everything here is built-in column functions: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

# The base patterns, with the shortest accepted length of a match (assign: of its value).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# Parts that count only when linked: an endpoint, and an unnamed key-like run.
ENDPOINT = r"https?://[A-Za-z0-9.-]+"
WEAK = r"[A-Za-z0-9+/]{40,}={0,2}"
SCOPE = 256
BLOCK = 256

SPAN = "array<struct<s:bigint,k:int,e:bigint>>"
KINDS = ["assign", "access", "hex", "endpoint", "weak"]


def _spans(text: str, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """Spans [start, end) in code points of the leftmost non-overlapping matches, short ones dropped.

    Splitting at the pattern gives the gaps before the matches, so running sums of lengths give the positions.
    """
    regex = F.lit(pattern)
    gaps = F.transform(F.split(F.col(text), pattern, -1), lambda g: F.length(g).cast("long"))
    found = F.regexp_extract_all(F.col(text), regex, F.lit(0))
    lengths = F.transform(found, lambda m: F.length(m).cast("long"))
    value = lengths if group == 0 else F.transform(F.regexp_extract_all(F.col(text), regex, F.lit(group)), lambda m: F.length(m).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + x["l"]
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e")))
        return F.struct(e.alias("at"), F.when(x["v"] >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    zipped = F.zip_with(gaps, F.zip_with(lengths, value, lambda l, v: F.struct(l.alias("l"), v.alias("v"))),
                        lambda g, lv: F.struct(g.alias("g"), lv["l"].alias("l"), lv["v"].alias("v")))
    steps = F.filter(zipped, lambda x: x["l"].isNotNull())
    # Lists grow by copying, so they are summed in blocks, and then the blocks' ends: time stays near linear in the number of matches.
    starts = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda i: F.aggregate(F.slice(steps, i, F.lit(BLOCK)), start, step))
    ends = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["at"])))
    moved = F.zip_with(blocks, ends, lambda b, o: F.transform(b["out"], lambda x: F.struct((x["s"] + o).alias("s"), x["k"].alias("k"), (x["e"] + o).alias("e"))))
    spans = F.flatten(F.filter(moved, lambda m: m.isNotNull()))
    # Most texts match nowhere: those skip the split.
    return F.when(F.col(text).rlike(pattern if least < 2 or group else _at_least(pattern, least)), spans).otherwise(F.array().cast(SPAN))


def _at_least(pattern: str, least: int) -> str:
    """A quick necessary test for a match of that length."""
    if pattern == HEX:
        return r"[0-9a-f]{%d}" % least
    if pattern == ACCESS:
        return r"AKIA[A-Z0-9]{%d}" % (least - 4)
    return pattern


def _render(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _meets(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Distinct rows (_id, k, s, e) of ``left`` that come within ``scope`` of a row of ``right`` of the same text (overlap: -1).

    An interval join: spans are dealt to bins of the scope's width, so rows meet by an equal key and a bin of
    a text holds few of them, however long it is.
    """
    width = max(scope, 64)
    bins = lambda s, e: F.explode(F.sequence(F.expr(f"({s}) div {width}"), F.expr(f"({e}) div {width}")))
    a = left.select("_id", "k", "s", "e", bins(f"greatest(s - {scope}, 0)", f"e + {scope}").alias("bin"))
    b = right.select("_id", F.col("s").alias("s2"), F.col("e").alias("e2"), bins("s", "e").alias("bin"))
    close = (F.col("s2") <= F.col("e") + scope) & (F.col("e2") >= F.col("s") - scope)
    return a.join(b, ["_id", "bin"]).where(close).select("_id", "k", "s", "e").distinct()


def find_secrets(docs: DataFrame, keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all but text) with the arrays assign, access, hex, endpoint and weak of (s, k, e) in code points.

    Access identifiers, named secrets and long hexadecimal runs are always reported. An endpoint and an unnamed run of 40 characters or more
    are weak parts, reported only where a complementary part (access identifier, endpoint, secret: another kind than their own) lies within ``scope``
    code points in the same text. Unnamed runs that overlap a base span are that span, not a second one.

    Null text counts as empty; repeated rows each get their own result; whole texts of any length are read; an empty table gives an empty result. Columns
    of ``docs`` named like a result are replaced (``_id`` is taken). Base spans come from one narrow pass. Only texts with weak parts
    take part in the interval joins, as rows of numbers.
    """
    keep = [c for c in (keep or [c for c in docs.columns if c != "text"]) if c not in KINDS]
    d = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spans = {"assign": (ASSIGN, 0, 6, 2), "access": (ACCESS, 1, 20, 0), "hex": (HEX, 2, 24, 0), "weak": (WEAK, 4, 1, 0), "endpoint": (ENDPOINT, 3, 1, 0)}
    d = d.select(*keep, *[_spans("text", *args).alias(kind) for kind, args in spans.items()])
    # Row numbers are fixed by writing them once.
    d = stage(d.withColumn("_id", F.monotonically_increasing_id()), "spans")
    some = d.where((F.size("weak") > 0) | (F.size("endpoint") > 0)).where(F.size("weak") + F.size("endpoint") + F.size("assign") + F.size("access") + F.size("hex") > 1)
    parts = stage(some.select("_id", F.explode(F.concat(*KINDS)).alias("p")).select("_id", "p.k", "p.s", "p.e"), "parts")
    of = lambda *kinds: parts.where(F.col("k").isin([KINDS.index(k) for k in kinds]))
    # Ends are exclusive: spans that merely touch do not overlap.
    inner = of("assign", "access", "hex").withColumns({"s": F.col("s") + 1, "e": F.col("e") - 1})
    fresh = stage(of("weak").join(_meets(of("weak"), inner, 0), ["_id", "k", "s", "e"], "left_anti"), "fresh")
    linked = _meets(fresh, of("access", "endpoint"), scope).unionByName(_meets(of("endpoint"), of("access", "assign", "hex").unionByName(fresh), scope))
    found = linked.groupBy("_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("k") == KINDS.index(n), F.struct("s", "k", "e")))).cast(SPAN).alias(n) for n in ("endpoint", "weak")])
    out = d.drop("endpoint", "weak").join(found, "_id", "left")
    return out.select(*keep, "assign", "access", "hex", *[F.coalesce(n, F.array().cast(SPAN)).alias(n) for n in ("endpoint", "weak")])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    return d.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        F.sha2(_render(F.concat("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        _render(F.concat("assign", "access", "hex", "endpoint", "weak")).alias("spans"),
    )
