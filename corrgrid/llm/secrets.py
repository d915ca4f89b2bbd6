"""Secret scans with multipart credential linking (native).

Base spans come from three patterns. Weak candidates (user names and key identifiers, short or
unusual secrets, endpoints) are reported only when a complementary part of a credential lies
within their scope: an interval join of the candidates of a text with its identifiers, secrets and
endpoints, on text and scope-wide bins, keeps those that co-occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrgrid.llm.common import staged, text_or_empty
from corrgrid.llm.spans import joined, kind_spans, matches

#: The base patterns, least lengths and kinds in listed order.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}+"
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: Weak parts: their group 1 is the part.
WEAK_ID = r"(?i:\b(?:user(?:name)?|login|client_?id|access_?key(?:_?id)?|account))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,}+)"
WEAK_SECRET = r"(?i:\b(?:pass(?:phrase)?|pwd|pin|auth|credential|private_?key|signature))[\"']?\x20*[:=]\x20*[\"']?([^\x20\x09-\x0D\"']{6,}+)"
ENDPOINT = r"(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp|s3)://([^\x20\x09-\x0D\"'<>]++)"
#: Code points between the end of one part of a credential and the start of the next at most.
SCOPE = 200


def find_parts(text: Column) -> dict[str, Column]:
    """Base and weak spans of one text. Texts without the patterns' signs skip them."""
    assigned = text.contains("=") | text.contains(":")
    return {
        "assign": F.filter(matches(text, ASSIGN, guard=assigned, part=2), lambda x: F.length(x["part"]) >= LEAST_ASSIGN),
        "access": F.filter(matches(text, ACCESS, guard=text.contains("AKIA")), lambda x: F.length(x["text"]) >= LEAST_ACCESS),
        "hex": matches(text, HEX),
        "id": matches(text, WEAK_ID, guard=assigned, part=1),
        "secret": matches(text, WEAK_SECRET, guard=assigned, part=1),
        "endpoint": matches(text, ENDPOINT, guard=text.contains("://"), part=1),
    }


def link(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """rid, linked: the weak spans of a text that have a complementary part within the scope."""
    role = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "secret": "secret", "endpoint": "endpoint"}

    def part(kind: str) -> Column:
        weak = F.lit(kind not in ("assign", "access", "hex"))
        return F.transform(kind, lambda x: F.struct(F.lit(role[kind]).alias("role"), x["start"].alias("start"), x["end"].alias("end"), weak.alias("weak")))

    base = F.concat(*[part(k) for k in role])
    parts = rows.where(F.size("id") + F.size("secret") + F.size("endpoint") > 0).select("rid", F.inline(base))
    # A part lies in every bin that it touches, a weak part looks into every bin that its scope touches.
    bins = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    own = parts.where("weak").select("rid", "role", "start", "end", bins(F.col("start") - scope, F.col("end") + scope).alias("bin"))
    other = parts.select("rid", F.col("role").alias("other_role"), "start", "end", bins(F.col("start"), F.col("end")).alias("bin"))
    other = other.groupBy("rid", "other_role", "bin").agg(F.min("start").alias("low"), F.max("end").alias("high"), F.collect_set(F.struct("start", "end")).alias("held"))
    reach = lambda start, end: (start <= F.col("end") + scope) & (end >= F.col("start") - scope)
    near = (F.col("role") != F.col("other_role")) & reach(F.col("low"), F.col("high")) & F.exists("held", lambda x: reach(x["start"], x["end"]))
    linked = own.join(other, ["rid", "bin"]).where(near)
    rank = F.when(F.col("role") == "id", 3).when(F.col("role") == "secret", 4).otherwise(5)
    return linked.select("rid", F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.col("role").alias("kind")).alias("s")).groupBy("rid").agg(F.collect_set("s").alias("linked"))


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. spans lists base
    spans and linked weak parts (kinds id, secret, endpoint); found holds the base spans' texts.
    Repeated rows are scanned each, and a null doc_id is kept; empty tables give no rows; further
    columns are ignored.
    """
    parts = find_parts(text_or_empty(text_col))
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), *[c.alias(k) for k, c in parts.items()]))
    base = [kind_spans(F.col(k), i, k) for i, k in enumerate(("assign", "access", "hex"))]
    out = rows.join(link(rows, scope), "rid", "left")
    every = F.concat(*base, F.coalesce("linked", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"), F.transform(F.concat("assign", "access", "hex"), lambda x: x["text"]).alias("found"))
