"""Personal data with information-theoretic sanitisation (native).

Base spans come from four patterns. They are the protected entities. A term in a document with an
entity reveals it as far as seeing the term narrows the entity down: pointwise mutual information over the
entity's own information, log2(P(e|t) / P(e)) / -log2 P(e), with document counts over the whole
corpus. Terms above the disclosure threshold become spans of kind term and are generalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrgrid.llm.common import BROADCAST_IDS, SPACES, broadcast_if_small, staged, text_or_empty
from corrgrid.llm.spans import joined, kind_spans, matches

#: The base patterns in listed order. A match may start only where the run of its first
#: class starts or the last match ended, and possessive loops never give back: both leave the
#: matches as they are and keep the time linear on long runs.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: A term, the documents with the term and without the entity that are assumed unseen (they smooth rare
#: counts), and the share of the entity's information that a term may disclose.
WORDS = r"[\p{L}\p{N}]++"
UNSEEN, DISCLOSURE = 1, 0.9


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The digit sum with every second digit, from the right, doubled is a multiple of ten."""
    back = F.reverse(digits)
    at = lambda i: F.substring(back, i, 1).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, twice(at(i))).otherwise(at(i))) % 10 == 0


def find_entities(text: Column) -> dict[str, Column]:
    part = lambda x, i: F.element_at(F.split(x, r"\."), i)
    byte = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    card = lambda x: F.length(_digits(x)).between(12, 19) & _luhn(F.substring(_digits(x), 1, 19))
    return {
        "email": matches(text, EMAIL, guard=text.contains("@")),
        "ip": F.filter(matches(text, IP, guard=text.contains(".")), lambda x: byte(part(x["text"], 1)) & byte(part(x["text"], 2)) & byte(part(x["text"], 3)) & byte(part(x["text"], 4))),
        "card": F.filter(matches(text, CARD), lambda x: card(x["text"])),
        "phone": F.filter(matches(text, PHONE, guard=text.contains("+")), lambda x: F.length(_digits(x["text"])).between(9, 15)),
    }


#: Outer explodes below: an inner one makes Spark test the size of its array first, which computes it twice.
def terms_of(rows: DataFrame) -> DataFrame:
    """rid, term: the distinct words of three or more letters or digits of every text (rid, t)."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(WORDS), F.lit(0)), F.lower))
    return rows.select("rid", F.explode_outer(words).alias("term")).where(F.length("term") >= 3)


def occurrences(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rid, term, start, end of every occurrence of the terms (term) outside all entities of its text (rid, t, every)."""
    every = rows.select("rid", F.explode_outer(F.filter(matches(F.col("t"), WORDS), lambda x: F.length(x["text"]) >= 3)).alias("x"))
    words = every.select("rid", F.lower("x.text").alias("term"), F.col("x.start").alias("start"), F.col("x.end").alias("end")).join(terms, "term", "left_semi")
    # One sweep along each text: a word overlaps an entity if the furthest end of those that start before the word's end lies behind its start.
    spans = rows.select("rid", F.inline("every")).select("rid", F.col("start").alias("at"), F.lit(1).alias("span"), F.lit(None).cast("string").alias("term"), "start", "end")
    events = words.select("rid", F.col("end").alias("at"), F.lit(0).alias("span"), "term", "start", "end").unionByName(spans)
    sofar = Window.partitionBy("rid").orderBy("at", "span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("span") == 1, F.col("end"))).over(sofar)
    return events.withColumn("reach", reach).where((F.col("span") == 0) & F.coalesce(F.col("reach") <= F.col("start"), F.lit(True))).select("rid", "term", "start", "end")


def classes(rows: DataFrame) -> DataFrame:
    """rid, class, with_entity: entities that the same documents hold count alike, so they are one class."""
    held = rows.select("rid", F.explode("entities").alias("entity"))
    sign = F.struct(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.sum(F.xxhash64("rid", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    signs = held.groupBy("entity").agg(sign.alias("class"))
    return held.join(signs, "entity").select("rid", "class").distinct().withColumn("with_entity", F.col("class.k"))


def disclosing(rows: DataFrame, threshold: float) -> DataFrame:
    """rid, term spans: every occurrence of the terms that disclose an entity, by counts over the whole corpus.

    A pair of a term and an entity passes if both / (with_term + UNSEEN) >= (with_entity / n) ** (1 - threshold).
    As both <= with_entity, an entity can be disclosed only by terms with a bounded count: others never become pairs.
    """
    none = rows.where("false").select("rid", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>").alias("terms"))
    own = rows.where(F.size("every") > 0)
    n = rows.count()
    held = staged(classes(own))
    if held.isEmpty():
        return none
    held = held.withColumn("most", F.col("with_entity") * F.pow(n / F.col("with_entity"), 1 - threshold) * (1 + 1e-9) - UNSEEN)
    # Document frequency of every term of every text.
    each = terms_of(rows)
    terms = each.groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    near = terms_of(own).join(held.groupBy("rid").agg(F.max("most").alias("highest")), "rid")
    rare = near.join(terms, "term").where(F.col("with_term") <= F.col("highest")).select("rid", "term", "with_term")
    pairs = rare.join(held, "rid").where(F.col("with_term") <= F.col("most")).groupBy("class", "term").agg(F.count(F.lit(1)).alias("both"), F.first("with_term").alias("with_term"), F.first("with_entity").alias("with_entity"))
    info = -F.log2(F.col("with_entity") / n)
    pmi = F.log2((F.col("both") / (F.greatest("with_term", "both") + UNSEEN)) / (F.col("with_entity") / n))
    strong = staged(pairs.where((info > 0) & (pmi / info >= threshold)).select("term").distinct())
    strong = broadcast_if_small(strong, strong.count(), BROADCAST_IDS)
    holders = staged(each.join(strong, "term").select("rid").distinct())
    again = rows.join(broadcast_if_small(holders, holders.count(), BROADCAST_IDS), "rid", "left_semi")
    spans = occurrences(again, strong).select("rid", F.struct("start", F.lit(4).alias("rank"), "end", F.lit("term").alias("kind")).alias("s"))
    return spans.groupBy("rid").agg(F.collect_set("s").alias("terms"))


def generalise(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans count once."""
    step = lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out")))
    end = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text)))


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = DISCLOSURE, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (and sanitised).

    Offsets are code points, ends exclusive. Null and empty texts have no spans. A term is one word of
    three or more letters or digits; every document of the corpus that holds a disclosing term gets
    spans for its occurrences outside all entities.
    Repeated rows are scanned and counted each, and a null doc_id is kept; empty tables give no rows;
    further columns are ignored.
    """
    text = text_or_empty(text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), text.alias("t"), *[c.alias(k) for k, c in find_entities(text).items()])
    every = F.concat(*KINDS)
    entities = F.array_distinct(F.transform(every, lambda x: F.lower(F.regexp_replace(x["text"], SPACES, ""))))
    rows = staged(found.select("*", every.alias("every"), entities.alias("entities")))
    base = [kind_spans(F.col(k), i, k) for i, k in enumerate(KINDS)]
    terms = disclosing(rows, threshold)
    out = rows.join(terms, "rid", "left")
    spans = F.concat(*base, F.coalesce("terms", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")))
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    more = [generalise(F.col("t"), spans).alias("sanitised")] if with_text else []
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), *more)
