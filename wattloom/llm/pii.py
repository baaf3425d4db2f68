"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence.

Base spans are found per kind with linear-time patterns. Then an information-theoretic pass looks
at the words around each entity: with N documents, n(e) holding entity e, n(t) holding term t and
n(e,t) holding t within CONTEXT code points of e, the disclosure of e by t is
PMI(e;t) = log2(N n(e,t) / (n(e) n(t))) as a share of the entity's information content
IC(e) = log2(N / n(e)). Terms at or above REMOVE are removed, terms at or above GENERALISE are
generalised to the class of their shape: a code, a name or a word. An entity of one document counts like any
other: a term beside it discloses it the more, the fewer documents hold the term (share 1 - log n(t) / log N).

Everything runs as DataFrame expressions. Pairs come only from a window around each entity, so
their number is linear in the entities; hot pairs are pre-aggregated before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DID, THASH, held, keyed, written

#: Kinds in output order, with patterns equal to the documented ones. Possessive
#: quantifiers and look-behinds only cut backtracking that can't succeed.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CONTEXT, GENERALISE, REMOVE = 128, 0.75, 0.9
#: A term: three or more letters, digits and joining marks, a letter among them, between white space, brackets or
#: quotes before and closing punctuation after. So parts of addresses are none.
TERM = (
    r"(?<![^ \t\n\x0B\f\r(\[{\"\x27«“‘])(?=[\p{L}\p{N}\x27’_-]{3})(?=[\p{N}\x27’_-]*+\p{L})[\p{L}\p{N}]++(?:[\x27’_-][\p{L}\p{N}]++)*+"
    r"(?=[.,;:!?)\]}\"\x27»”’]*+(?:[ \t\n\x0B\f\r]|$))"
)
#: Matches of one row whose offsets are summed as one block.
_BLOCK = 256


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _valid(kind: str, v: str) -> str:
    """SQL condition that match v of the kind passes its check."""
    if kind == "ip":
        return rf"forall(split({v}, '[.]'), p -> p rlike r'^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')"
    if kind == "card":
        luhn = f"""aggregate(sequence(1, length({_digits(v)})), 0L, (acc, i) -> acc + element_at(
            array(cast(substring({_digits(v)}, -i, 1) as int),
                  (2 * cast(substring({_digits(v)}, -i, 1) as int)) div 10 + (2 * cast(substring({_digits(v)}, -i, 1) as int)) % 10),
            2 - i % 2)) % 10 = 0"""
        return f"length({_digits(v)}) BETWEEN 13 AND 19 AND {luhn}"
    if kind == "phone":
        return f"length({_digits(v)}) BETWEEN 9 AND 15"
    return "true"


def _located(pieces: str, found: str) -> str:
    """SQL array of (at, i): code-point start of match i, from the pieces between matches.

    Lengths are summed in blocks, so a row with many matches costs n * _BLOCK and not n * n.
    """
    adv = f"transform(sequence(0, size({found}) - 1), j -> length({pieces}[j]) + length({found}[j]))"
    return f"""transform(array({adv}), adv ->
        transform(array(transform(sequence(0, (size({found}) - 1) div {_BLOCK}),
                        b -> aggregate(slice(adv, 1, b * {_BLOCK}), 0, (s, x) -> s + x))), base ->
            transform(sequence(0, size({found}) - 1), i -> named_struct('i', i, 'at',
                base[i div {_BLOCK}] + length({pieces}[i])
                + aggregate(slice(adv, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), 0, (s, x) -> s + x)))))[0][0]"""


_EMPTY_SPANS = "cast(array() as array<struct<kind: string, start: int, end: int, value: string, before: string, after: string>>)"


def _with_spans(rows: DataFrame) -> DataFrame:
    """Adds <kind>_s: valid spans of each kind with the text around them."""
    for kind, pattern in KINDS.items():
        m, p = f"{kind}_m", f"{kind}_p"
        rows = rows.withColumn(m, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        rows = rows.withColumn(p, F.when(F.size(m) > 0, F.split("text", pattern, -1)))
        rows = rows.withColumn(
            f"{kind}_s",
            F.expr(f"""CASE WHEN size({m}) > 0 THEN transform(filter(transform({_located(p, m)}, x -> named_struct(
                'kind', '{kind}', 'start', x.at, 'end', x.at + length({m}[x.i]), 'value', {m}[x.i])),
                s -> {_valid(kind, 's.value')}), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'value', s.value,
                'before', CASE WHEN s.start > {CONTEXT}
                    THEN regexp_replace(substring(text, s.start - {CONTEXT} + 1, {CONTEXT}), r'^\\S+', '') ELSE left(text, s.start) END,
                'after', CASE WHEN length(text) - s.end > {CONTEXT}
                    THEN regexp_replace(substring(text, s.end + 1, {CONTEXT}), r'\\S+$', '') ELSE substring(text, s.end + 1) END)) ELSE {_EMPTY_SPANS} END"""),
        ).drop(m, p)
    return rows


def _text_of(spans: str) -> Column:
    return F.expr(f"concat_ws(',', transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)))")


def base_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, row key, and spans: array of (kind, start, end, value, before, after) by kind, then start."""
    found = _with_spans(keyed(docs, text=text, doc_id=doc_id))
    return found.select("doc_id", DID, THASH, F.concat(*[F.col(f"{k}_s") for k in KINDS]).alias("spans"))


def _terms(side: str, origin: str) -> str:
    """SQL array of (term, start, end) in one side of a span; origin: SQL start of that side."""
    m, p = f"regexp_extract_all({side}, r'{TERM}', 0)", f"split({side}, r'{TERM}', -1)"
    inner = _located("pm.p", "pm.m")
    return f"""CASE WHEN size({m}) > 0 THEN transform(array(named_struct('m', {m}, 'p', {p})), pm ->
        transform({inner}, x -> named_struct('term', lower(pm.m[x.i]), 'start', {origin} + x.at,
            'end', {origin} + x.at + length(pm.m[x.i]), 'word', pm.m[x.i])))[0]
        ELSE cast(array() as array<struct<term: string, start: int, end: int, word: string>>) END"""


def meetings(found: DataFrame) -> DataFrame:
    """One row per term beside an entity: row key, entity kind and value, term and its place."""
    span = found.select(DID, THASH, F.explode("spans").alias("s")).select(DID, THASH, "s.*")
    both = f"concat({_terms('before', 'start - length(before)')}, {_terms('after', 'end')})"
    return span.select(DID, THASH, "kind", F.lower("value").alias("entity"), F.explode(F.expr(both)).alias("t")).select(
        DID, THASH, "kind", "entity", "t.term", "t.start", "t.end"
    )


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_term): documents that hold each term, over whole texts."""
    term = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(TERM), F.lit(0)))
    return docs.select(F.explode(term).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))


def disclosures(docs: DataFrame, found: DataFrame, met: DataFrame, text: str = "text") -> DataFrame:
    """(kind, entity, term, share, action): terms whose disclosure of an entity exceeds a threshold."""
    total = F.lit(float(max(1, found.count())))
    entities = (
        found.select(DID, THASH, F.explode("spans").alias("s"))
        .select(DID, THASH, F.col("s.kind").alias("kind"), F.lower("s.value").alias("entity"))
        .distinct().groupBy("kind", "entity").agg(F.count("*").alias("n_entity"))
    )
    pairs = met.select(DID, THASH, "kind", "entity", "term").distinct().groupBy("kind", "entity", "term").agg(F.count("*").alias("n_pair"))
    known = pairs.join(entities, ["kind", "entity"]).join(term_counts(docs, text), "term")
    ic = F.log2(total / F.col("n_entity"))
    pmi = F.log2(total * F.col("n_pair") / (F.col("n_entity") * F.col("n_term")))
    share = F.when(ic > 0, pmi / ic).otherwise(F.lit(0.0))
    return known.select(
        "kind", "entity", "term", share.alias("share"), F.when(share >= REMOVE, "remove").otherwise("generalise").alias("action")
    ).where(F.col("share") >= GENERALISE)


def sanitised_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document row: doc_id, row key, base spans, and disclosing-term spans.

    terms is an array of (kind, start, end, class), kind 'generalise' or 'remove', by kind and start. Null
    text counts as empty and has no span. Repeated rows each keep their row and get equal spans;
    they count as one document in the co-occurrence statistics. An empty table gives an empty one.
    """
    found = held(base_spans(docs, text, doc_id))
    met = written(meetings(found), "meetings")
    told = disclosures(docs, found, met, text).select("kind", "entity", "term", "action")
    holds = found.select(DID, THASH, F.explode("spans").alias("s")).select(DID, THASH, F.col("s.kind").alias("kind"), F.lower("s.value").alias("entity")).distinct()
    marked = holds.join(told, ["kind", "entity"]).groupBy(DID, THASH, "term").agg(F.max("action").alias("action"))
    marked = marked.groupBy(DID, THASH).agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("told"))
    # Every place of a disclosing term in a document that holds its entity, in the context or not.
    placed = keyed(docs, text=text, doc_id=doc_id).dropDuplicates([DID, THASH]).join(marked, [DID, THASH])
    places = f"filter({_terms('text', '0')}, t -> map_contains_key(told, t.term))"
    shape = "CASE WHEN t.word rlike r'\\p{N}' THEN 'code' WHEN t.word rlike r'^\\p{Lu}' THEN 'name' ELSE 'word' END"
    per_doc = placed.select(DID, THASH, F.expr(f"sort_array(transform({places}, t -> named_struct('kind', told[t.term], 'start', t.start, 'end', t.end, 'class', {shape})))").alias("terms"))
    none = F.expr("cast(array() as array<struct<kind: string, start: int, end: int, class: string>>)")
    return found.join(per_doc, [DID, THASH], "left").withColumn("terms", F.coalesce("terms", none))


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, sanitised): entities are replaced by [KIND], generalised terms by their [class], removed terms by nothing.

    Of overlapping spans the one that starts first (then the longest) decides.
    """
    rows = keyed(docs, text=text, doc_id=doc_id)
    spans = sanitised_spans(docs, text, doc_id).select(DID, THASH, "spans", "terms").dropDuplicates([DID, THASH])
    ordered = F.expr("""sort_array(concat(
        transform(spans, s -> named_struct('start', s.start, 'back', -s.end, 'put', concat('[', upper(s.kind), ']'))),
        transform(terms, s -> named_struct('start', s.start, 'back', -s.end, 'put', CASE s.kind WHEN 'remove' THEN '' ELSE concat('[', s.class, ']') END))))""")
    built = F.expr("""aggregate(ordered, named_struct('at', 0, 'out', cast('' as string)),
        (a, s) -> CASE WHEN s.start < a.at THEN a ELSE named_struct('at', -s.back,
            'out', concat(a.out, substring(text, a.at + 1, s.start - a.at), s.put)) END,
        a -> concat(a.out, substring(text, a.at + 1)))""")
    return rows.join(spans, [DID, THASH]).withColumn("ordered", ordered).select("doc_id", built.alias("sanitised"))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans, digest of their list, and the list of all spans."""
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    rows = sanitised_spans(docs)
    return rows.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(_text_of("spans"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.size("spans") > 0, _text_of("spans")), F.when(F.size("terms") > 0, _text_of("terms"))).alias("spans"),
    )
