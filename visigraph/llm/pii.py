"""Operator 7: personal data, in DataFrame functions only.

Identifiers (email, ip, card, phone) are found by pattern and test. Around them, information theory decides which terms give
them away. An identifier is rare, so what its neighbours reveal is estimated for the identifier and for what it shares with others
(`entities`): an address's user name and domain, an ip's network, a card's issuer, a phone's exchange. Over the corpus, a term t that stands
within CONTEXT characters of an entity e in n_et documents of m different texts, while e is in n_e, t in n_t and N documents are there, leaves
-log2(p) bits of doubt about e, where p = n_et / n_t * m / (m + PRIOR) is the share of t's documents that point to e, shrunk by what few
texts can prove. Where at most DOUBT bits are left, and at least DISCLOSED of e's own information log2(N / n_e) is given, reading t is as good as
reading e, so t is replaced everywhere. Both bounds mean the same at any N. Spans become a general label in `sanitise`, or are removed.

Defined results: null text is empty and without spans; counts of documents are counts of rows, so rows that repeat count again, but m
counts different texts; a term inside an identifier is no span of its own; an empty table gives no rows; added columns replace
others of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Work, ascii_lower, join_small, shared_dir, table

#: Possessive forms, which find the same matches without going back; a run that failed at its start is not tried again from inside.
_USER = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_USER})|\G){_USER}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
#: A text without a match of this has no span of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"

CONTEXT = 120
#: Bits of doubt that a disclosing term may leave, the least share of an entity's information that it gives, and the texts without
#: the entity that each term is credited with before any is seen.
DOUBT = 1.0
DISCLOSED = 0.5
PRIOR = 2
SHORTEST = 3


def luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: Column, kind: str) -> Column:
    """array<struct<start, kind, end, found>> of the leftmost matches: what lies between them gives the places."""
    between, hits = F.transform(F.split(text, pattern, -1), F.length), F.regexp_extract_all(text, pattern, F.lit(0))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>").alias("spans"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.length(x["found"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), x["found"].alias("found"))
        return F.struct(end.alias("at"), F.array_append(done["spans"], span).alias("spans"))

    pairs = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda gap, found: F.struct(gap.alias("gap"), found.alias("found")))
    return F.aggregate(pairs, empty, step, lambda done: done["spans"])


NONE = "array<struct<start:int,kind:int,end:int,found:string>>"


def base_spans(text: Column) -> Column:
    def of(kind: str) -> Column:
        found = F.filter(matches(text, F.lit(PATTERNS[kind]), kind), lambda s: passes(kind, s["found"]))
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
        return F.when(hint, found).otherwise(F.array().cast(NONE))

    return F.array_sort(F.concat(*map(of, PATTERNS)))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD + "+"), F.lit(0))


def context_terms(text: Column, span: Column) -> Column:
    """The terms within CONTEXT characters on both sides of a span; a term that the edge may have cut is left out."""
    left = ascii_lower(F.substring(text, F.greatest(span["start"] + 1 - CONTEXT, F.lit(1)), F.least(span["start"], F.lit(CONTEXT))))
    right = ascii_lower(F.substring(text, span["end"] + 1, F.lit(CONTEXT)))
    left = F.when(span["start"] > CONTEXT, F.regexp_replace(left, f"^{WORD}+", "")).otherwise(left)
    right = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, f"{WORD}+$", "")).otherwise(right)
    return F.filter(F.array_distinct(F.concat(words(left), words(right))), lambda w: (F.length(w) >= SHORTEST) & w.rlike("[^0-9]"))


def found_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.drop("base", "spans", "_op7_h").withColumn("base", base_spans(text)).withColumn("_op7_h", F.xxhash64(text))


def entities(span: Column) -> Column:
    """The identifier of a span, in lower case, and what it shares with others of its kind."""
    found = ascii_lower(span["found"])
    digits = F.regexp_replace(found, "[^0-9]", "")
    user, domain = F.regexp_replace(F.substring_index(found, "@", 1), "[0-9._%+-]+$", ""), F.substring_index(found, "@", -1)
    shared = {
        "email": F.filter(F.array(F.concat(user, F.lit("@")), F.concat(F.lit("@"), domain)), lambda e: e != "@"),
        "ip": F.array(F.regexp_replace(found, "[0-9]+$", "")),
        "card": F.array(F.concat(F.lit("card "), F.substring(digits, 1, 6))),
        "phone": F.array(F.concat(F.lit("+"), F.substring(digits, F.lit(1), F.length(digits) - 4))),
    }
    return F.concat(F.array(found), *(F.when(span["kind"] == KINDS.index(kind), own).otherwise(F.array().cast("array<string>")) for kind, own in shared.items()))


def disclosing_terms(docs: DataFrame, doubt: float = DOUBT, disclosed: float = DISCLOSED, prior: int = PRIOR) -> DataFrame:
    """(term, entity, n_et, m, n_e, n_t, doubt, information) of the terms that reveal an entity. docs: as found_rows gives them.

    What is gathered follows mentions, not documents times terms. Pairs that too few texts hold for any n_t to pass go before terms are counted."""
    total, work = docs.count(), Work(docs.sparkSession)
    # the few texts that hold an identifier are stored with their spans, so patterns run once for both counts
    texts = work.store(docs.where(F.size("base") > 0).select(F.monotonically_increasing_id().alias("_op7_row"), "_op7_h", "text", "base"), "mentions")
    mentions = texts.select("_op7_row", F.explode("base").alias("s")).select("_op7_row", F.explode(entities(F.col("s"))).alias("entity")).distinct()
    held = mentions.groupBy("entity").agg(F.count("*").alias("n_e"))
    # a row for each mention and what is about it, so that no text with many identifiers becomes one large array; pairs repeat within a text
    around = texts.select("_op7_row", "_op7_h", "text", F.explode("base").alias("s")).select("_op7_row", "_op7_h", F.explode(entities(F.col("s"))).alias("entity"), context_terms(F.col("text"), F.col("s")).alias("terms"))
    near = around.select("_op7_row", "_op7_h", "entity", F.explode("terms").alias("term")).distinct()
    pairs = near.groupBy("_op7_h", "entity", "term").agg(F.count("*").alias("rows"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("rows").alias("n_et"), F.count("*").alias("m")).where(-F.log2(F.col("m") / (F.col("m") + prior)) <= doubt)
    # stored, so that a join may split the rows of a common domain
    pairs = work.store(pairs, "pairs").join(work.store(held, "held"), "entity").checkpoint()
    work.drop(texts)
    terms = pairs.select("term").distinct().checkpoint()
    n = terms.count()
    spread = docs.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    # beyond the broadcast bound words are counted first: each task sends a word once, so a frequent one is no hot key
    wanted = spread.join(F.broadcast(terms), "term", "left_semi") if n <= BROADCAST_ROWS else spread
    counts = wanted.groupBy("term").agg(F.count("*").alias("n_t"))
    left = -F.log2(F.col("n_et") * F.col("m") / (F.col("n_t") * (F.col("m") + prior)))
    scored = pairs.join(counts, "term").withColumn("doubt", left).withColumn("information", F.log2(total / F.col("n_e").cast("double")))
    return scored.where((F.col("doubt") <= doubt) & (F.col("doubt") <= (1 - disclosed) * F.col("information")))


def find(docs: DataFrame, doubt: float = DOUBT, disclosed: float = DISCLOSED, prior: int = PRIOR) -> DataFrame:
    """docs with base and spans (base and the terms that disclose), both array<struct<start, kind, end, found>> by start and kind."""
    shared_dir(docs.sparkSession)
    rows = found_rows(docs)
    terms = disclosing_terms(rows, doubt, disclosed, prior).select("term").distinct().checkpoint()
    n = terms.count()
    if not n:
        return rows.drop("_op7_h").withColumn("spans", F.col("base"))
    # documents are joined by a hash of their text; a chance hit only adds terms that the text may hold
    spread = rows.select("_op7_h", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    holders = join_small(spread, terms, ["term"], "inner", n, salt=F.pmod("_op7_h", F.lit(32)).cast("int")).groupBy("_op7_h").agg(F.array_sort(F.collect_set("term")).alias("_op7_terms")).checkpoint()
    rows = join_small(rows, holders, ["_op7_h"], "left", holders.count(), salt=F.pmod(F.monotonically_increasing_id(), F.lit(32)).cast("int")).drop("_op7_h")
    pattern = F.concat(F.lit(f"(?<!{WORD})(?:"), F.array_join("_op7_terms", "|"), F.lit(f")(?!{WORD})"))
    more = F.filter(matches(ascii_lower(F.col("text")), pattern, "term"), lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return rows.withColumn("_op7_more", F.when(F.col("_op7_terms").isNotNull(), more).otherwise(F.array().cast(NONE))).withColumn("spans", F.array_sort(F.concat("base", "_op7_more"))).drop("_op7_terms", "_op7_more")


def sanitise(found: DataFrame, remove: bool = False) -> DataFrame:
    """text with each span replaced by its kind in brackets, or removed; of spans that overlap the first gives the label."""
    names = F.array(*(F.lit("" if remove else f"[{k.upper()}]") for k in KINDS))
    text = F.coalesce("text", F.lit(""))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, s: Column) -> Column:
        inside = s["start"] < done["at"]
        kept = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        parts = F.when(inside, done["parts"]).otherwise(F.concat(done["parts"], F.array(kept, names[s["kind"]])))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), parts.alias("parts"))

    changed = F.aggregate("spans", empty, step, lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size("spans") > 0, changed).otherwise(F.col("text")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == KINDS.index(kind))).cast("long").alias(f"n_{kind}") for kind in PATTERNS]  # noqa: B023
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _base_sql(kind: str) -> str:
    pattern = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}[kind]
    digits = "regexp_replace(found, '[^0-9]', '', 'g')"
    test = {
        "email": "true",
        "ip": "len(list_filter(string_split(found, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse({digits}), ''), lambda d, i: CASE WHEN i % 2 = 0 THEN CAST(d AS INT) * 2 - CASE WHEN CAST(d AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(d AS INT) END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }[kind]
    return f"""
    SELECT row_id, {KINDS.index(kind)} AS kind, start, start + length(found) AS stop, found FROM (
        SELECT row_id, found, CAST(sum(length(gap)) OVER w + coalesce(sum(length(found)) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM (SELECT row_id, unnest(hits) AS found, unnest(gaps[1 : len(hits)]) AS gap, unnest(range(len(hits))) AS i
              FROM (SELECT row_id, regexp_extract_all(text, '{pattern}') AS hits, regexp_split_to_array(text, '{pattern}') AS gaps FROM d) WHERE len(hits) > 0)
        WINDOW w AS (PARTITION BY row_id ORDER BY i)
    ) WHERE {test}"""


_SQL_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SQL_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), b AS ({" UNION ALL ".join(map(_base_sql, PATTERNS))}
), c AS (
    SELECT b.row_id, d.text, unnest([e] || CASE kind
               WHEN 0 THEN [u || '@' FOR u IN [regexp_replace(split_part(e, '@', 1), '[0-9._%+-]+$', '')] IF u <> ''] || ['@' || split_part(e, '@', 2)]
               WHEN 1 THEN [regexp_replace(e, '[0-9]+$', '')] WHEN 2 THEN ['card ' || substr(n, 1, 6)] ELSE ['+' || substr(n, 1, length(n) - 4)] END) AS entity, start,
           substr(d.low, CAST(greatest(start + 1 - {CONTEXT}, 1) AS INT), CAST(least(start, {CONTEXT}) AS INT)) AS l, substr(d.low, CAST(stop + 1 AS INT), {CONTEXT}) AS r
    FROM (SELECT *, translate(found, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS e, regexp_replace(found, '[^0-9]', '', 'g') AS n FROM b) AS b JOIN d ON b.row_id = d.row_id
), near AS (
    SELECT DISTINCT row_id, text, entity, unnest(list_concat({_SQL_WORDS.format("CASE WHEN start > " + str(CONTEXT) + " THEN regexp_replace(l, '^" + _SQL_WORD + "+', '') ELSE l END")},
        {_SQL_WORDS.format("CASE WHEN length(r) = " + str(CONTEXT) + " THEN regexp_replace(r, '" + _SQL_WORD + "+$', '') ELSE r END")})) AS term FROM c
), e AS (
    SELECT entity, count(DISTINCT row_id) AS n_e FROM c GROUP BY entity
), p AS (
    SELECT near.entity, term, count(*) AS n_et, count(DISTINCT text) AS m, any_value(n_e) AS n_e FROM near JOIN e ON near.entity = e.entity
    WHERE length(term) >= {SHORTEST} AND regexp_matches(term, '[^0-9]') GROUP BY near.entity, term HAVING -log2(m / (m + {PRIOR})) <= {DOUBT}
), w AS (
    SELECT DISTINCT row_id, unnest({_SQL_WORDS.format("text")}) AS term FROM d
), t AS (
    SELECT term, count(*) AS n_t FROM w WHERE term IN (SELECT term FROM p) GROUP BY term
), flagged AS (
    SELECT DISTINCT term FROM (SELECT term, -log2(CAST(n_et * m AS DOUBLE) / (n_t * (m + {PRIOR}))) AS doubt, log2(n / CAST(n_e AS DOUBLE)) AS information
        FROM p JOIN t USING (term), (SELECT CAST(count(*) AS DOUBLE) AS n FROM d))
    WHERE doubt <= {DOUBT} AND doubt <= {1 - DISCLOSED} * information
), own AS (
    SELECT d.row_id, unnest({_SQL_WORDS.format("text")}) AS found, unnest(regexp_split_to_array(low, '{_SQL_WORD}+')[1 : len({_SQL_WORDS.format("text")})]) AS gap, unnest(range(len({_SQL_WORDS.format("text")}))) AS i
    FROM d WHERE row_id IN (SELECT row_id FROM w WHERE term IN (SELECT term FROM flagged))
), place AS (
    SELECT row_id, found, CAST(sum(length(gap)) OVER (PARTITION BY row_id ORDER BY i) + coalesce(sum(length(found)) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM own
), s AS (
    SELECT row_id, kind, start, stop FROM b UNION ALL
    SELECT row_id, 4, start, start + length(found) FROM place WHERE found IN (SELECT term FROM flagged)
        AND NOT EXISTS (SELECT 1 FROM b WHERE b.row_id = place.row_id AND b.start < place.start + length(place.found) AND place.start < b.stop)
), g AS (
    SELECT row_id, string_agg(['email', 'ip', 'card', 'phone', 'term'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
           string_agg(['email', 'ip', 'card', 'phone'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 4) AS base,
           {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(PATTERNS))} FROM s GROUP BY row_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in PATTERNS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.row_id = g.row_id
"""
