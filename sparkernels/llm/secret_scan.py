"""Secret scans: single-pattern spans, and weak parts of credentials linked by interval joins within scopes.

Only DataFrame functions run here. A pattern's spans come from splitting a text at its matches: the lengths of the
pieces and of the matches, summed in order, give offsets in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, prepare, text_key

#: The base patterns by kind, the group whose length counts, and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))

#: Parts too weak to report alone: an identifier, a secret value and an endpoint.
PARTS = (
    ("part_id", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{8,}|(?i:(?:access|client|user|account)[_-]?(?:key[_-]?)?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{4,}"),
    ("part_secret", r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9a-z+/_.=-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_.=-])|(?i:password|passwd|secret)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,11}(?![A-Za-z0-9+/_.=-])|(?i:pwd)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}"),
    ("part_endpoint", r"(?i:https?|jdbc:[a-z0-9]+|s3|redis|amqps?|mongodb|postgres(?:ql)?|mysql)://[A-Za-z0-9_.@%-]+(?::[0-9]+)?(?:/[A-Za-z0-9_.%/-]*)?"),
)
#: A cheap test for any part, so most texts skip their patterns.
HINT = r"AKIA|ASIA|://|(?i:[_-]?id[\"']?\x20*[:=]|password|passwd|secret|pwd)"

#: Kinds that link as another: base spans, reported anyway, are secrets or identifiers beside weak parts.
ROLES = {"assign": "part_secret", "hex": "part_secret", "access": "part_id"}

#: Parts link within one scope and so many code points. A scope ends at a blank line, a line of dashes or a section's heading.
SCOPE = 256
BREAK = r"\n[\x20\t\r]*\n|\n-{3,}[\x20\t\r]*(?=\n)|\n(?=\[[^\[\]\n]{1,80}\][\x20\t\r]*\n)"

KINDS = [k for k, *_ in BASE] + [k for k, _ in PARTS]


def _cut(text: Column, pattern: str, group: int) -> Column:
    """Of each match, in order: code points of the piece before it, of the match and of its group."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    inner = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m)) if group else whole
    return F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("piece"), whole.alias("whole"), inner.alias("inner"))


def _found(docs: DataFrame) -> DataFrame:
    """doc_id, key, kind, lo, hi, scope of every span of every pattern, repeated rows once, too short base spans dropped."""
    text = F.coalesce("text", F.lit(""))
    hinted = text.rlike(HINT)
    least = F.create_map(*[x for k, _, _, n in BASE for x in (F.lit(k), F.lit(n))])
    # A short hex run is always dropped, so the pattern itself asks for the length; offsets stay the same.
    cuts = [F.when(text.rlike(p), _cut(text, p, g)).alias(k) for k, p, g, _ in (BASE[0], BASE[1], ("hex", HEX[:-1] + "{16,}", 0, 16))]
    cuts += [F.when(hinted & text.rlike(p), _cut(text, p, 0)).alias(k) for k, p in PARTS]
    cuts.append(F.when(hinted & text.rlike(BREAK), _cut(text, BREAK, 0)).alias("break"))
    wide = docs.select("doc_id", text_key().alias("key"), *cuts)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("cuts")) for k in (*KINDS, "break")])
    each = wide.where(F.coalesce(*[F.col(k) for k in KINDS]).isNotNull()).select("doc_id", "key", F.explode(kinds).alias("k")).select("doc_id", "key", "k.kind", F.posexplode("k.cuts").alias("n", "cut"))
    each = each.select("doc_id", "key", "kind", "n", "cut.piece", "cut.whole", "cut.inner").dropDuplicates(["doc_id", "key", "kind", "n"])
    upto = F.sum(F.col("piece") + F.col("whole")).over(Window.partitionBy("doc_id", "key", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    spans = each.withColumn("hi", upto.cast("long")).withColumn("lo", F.col("hi") - F.col("whole"))
    long = spans.where(F.coalesce(F.col("inner") >= least[F.col("kind")], F.lit(True))).select("doc_id", "key", "kind", "lo", "hi")
    scope = F.sum((F.col("kind") == "break").cast("int")).over(Window.partitionBy("doc_id", "key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0))
    return long.withColumn("scope", scope).where("kind <> 'break'")


def _linked(spans: DataFrame) -> DataFrame:
    """The weak parts that have a complementary part within their scope: doc_id, key, kind, lo, hi.

    A secret complements an identifier or an endpoint and they a secret; an identifier and an endpoint alone are nothing.
    An interval join: of two parts the one behind starts in the bin in which the one before ends or in the next, as
    the gap between them is a scope at most, however long they are. A bin holds at most as many starts, and as many
    ends, of a kind as the scope has code points. Base spans with a role (ROLES) are partners here, not results.
    """
    role = F.col("kind")
    for kind, as_ in ROLES.items():
        role = F.when(F.col("kind") == kind, as_).otherwise(role)
    weak = [k for k, _ in PARTS]
    parts = spans.where(F.col("kind").isin([*weak, *ROLES])).withColumn("role", role)
    behind = parts.withColumn("bin", F.floor(F.col("lo") / SCOPE))
    first = F.floor(F.col("hi") / SCOPE)
    before = parts.withColumn("bin", F.explode(F.array(first, first + 1)))

    def met(mine: DataFrame, other: DataFrame, gap: Column) -> DataFrame:
        on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.scope") == F.col("b.scope")) & ((F.col("a.role") == "part_secret") != (F.col("b.role") == "part_secret")) & gap.between(0, SCOPE)
        return mine.where(F.col("kind").isin(weak)).alias("a").join(other.alias("b"), on, "left_semi").select("a.doc_id", "a.key", "a.kind", "a.lo", "a.hi")

    return met(before, behind, F.col("b.lo") - F.col("a.hi")).union(met(behind, before, F.col("a.lo") - F.col("b.hi"))).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans) of the rows of docs (doc_id, text) that have any: array<struct<lo, rank, kind, hi>> in order.

    Base kinds are reported wherever they match. An identifier or endpoint too weak for that is reported only when a
    secret lies within SCOPE code points of it in the same scope without overlapping it, and a weak secret when an
    identifier or endpoint does; assigned and hex base spans count as secrets for that, access ones as identifiers.
    Null and empty texts have no spans; repeated rows share one result; several spans may share a place.
    """
    prepare(docs.sparkSession)
    spans = Table(_found(docs), "spans").df
    base = spans.where(F.col("kind").isin([k for k, *_ in BASE])).drop("scope")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    each = base.union(_linked(spans)).withColumn("span", F.struct("lo", rank.alias("rank"), "kind", "hi"))
    return each.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("span")).alias("spans"))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans (all of them, kind:start:end by start and kind)."""
    found = scan(docs)
    mine = docs.select("doc_id", text_key().alias("key")).alias("d")
    all_ = mine.join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key")), "left")
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<lo:bigint,rank:int,kind:string,hi:bigint>>"))
    out = all_.select(F.col("d.doc_id").alias("doc_id"), spans.alias("spans"))
    base = F.filter("spans", lambda s: s["rank"] <= len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k, *_ in BASE]
    return out.select("doc_id", *counts, F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))
