r"""Personal data: fixed patterns, then information-theoretic sanitisation of terms that reveal them. DataFrame functions only.

Every base match stands for two protected entities: its kind and normalised value, and
a part that other values share (an e-mail's domain, a card's issuer digits, an
address's network, a phone number's first digits). For a term t and an entity e, over
all texts, with N words in all,

    PMI(t; e) = ln( n(t, e) * N / (n(t) * n(e)) ),   IC(e) = -ln( n(e) / N )

where n(t) counts t in all texts, n(e) the context words of e (CONTEXT words on
either side of a match) and n(t, e) those of them that are t. Their ratio tells
how much of the entity's information the term gives away; it is 1 if t occurs
nowhere else. From GENERALISE on a term is generalised to a class word, from
REMOVE on it is removed, in every text that holds the entity. Any run of letters, their
combining marks and digits is a term, short ones and numbers too; the ratio alone spares
common ones. A term needs the evidence of SUPPORT different texts; a context that stands
in several texts is evidence of one of them only. So neither a text that names an entity
often, nor its exact copies, nor copies with edits elsewhere accuse anything alone.

Offsets are code points, end exclusive. Java's possessive quantifiers give the
same matches as the plain patterns, without recursion and in linear time.

Defined cases: null and empty text have no spans (and stay as they are when
sanitised); rows are keyed by their text, so repeated rows and null or repeated
doc_ids are handled alike; an empty table gives no rows; other columns are kept
by ``sanitise`` (its own work columns start with ``_pii``) and ignored elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, small, written

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns: the contract's, possessive where nothing that follows could take a character back, and begun only where a leftmost match can begin.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a valid match must hold; one plain search settles most texts.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LETTER = r"[\p{L}\p{M}\p{N}]"
WORD = rf"[\p{{L}}\p{{N}}]{LETTER}*+"
#: Fixed thresholds.
CONTEXT, SUPPORT = 8, 2
GENERALISE, REMOVE = 0.9, 0.99
#: Characters on either side of a match that are searched first for its context words; where they hold too few, the whole side is.
REACH = 160


PLACES = "array<struct<s:int,e:int,m:string,removed:boolean>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether at most 19 digits pass the Luhn test."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(19):
        d = F.substring(padded, i + 1, 1)
        total = total + (F.translate(d, "0123456789", "0246813579") if i % 2 == 17 % 2 else d).cast("int")
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(m))
    return (n.between(13, 19) & luhn(_digits(m))) if kind == "card" else n.between(9, 15)


STEP = 256


def positions(text: Column, pattern: Column | str) -> Column:
    """array<struct<s, e, m>> of the matches: what stands between matches is what ``split`` leaves, so starts are running sums (in two levels, to stay short of the square of their number)."""
    found = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def located(found, gaps):
        # arrays_zip gives the last gap a null match, which is cut off again
        both = F.slice(F.arrays_zip(gaps.alias("g"), found.alias("m")), F.lit(1), F.size(found))
        item = F.transform(both, lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("w"), x["m"].alias("m")))

        def chunks(items):
            return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int")), lambda b: F.slice(items, (b * STEP + 1).cast("int"), F.lit(STEP)))

        def run(acc, x):
            s = acc["at"] + x["g"]
            return F.struct((s + x["w"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["w"]).alias("e"), x["m"].alias("m")))).alias("out"))

        def outer(acc, part):
            inner = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out")), run)
            return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<s:int,e:int,m:string>>>").alias("out"))
        return F.flatten(F.aggregate(chunks(item), start, outer)["out"])

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return F.when(F.size(found) > 0, located(found, gaps)).otherwise(none)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<s, e, m>> of the valid matches of a kind; null text has none."""
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    spans = F.filter(positions(text, PATTERNS[kind]), lambda x: valid(kind, x["m"]))
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(none)


def normalised(kind: Column, m: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), _digits(m)).otherwise(F.lower(m)))


def entities(x: Column) -> Column:
    """The protected entities of a match struct (kind, m): its value, and the part that it shares with others."""
    digits, low = _digits(x["m"]), F.lower(x["m"])
    part = F.when(x["kind"] == "email", F.substring_index(low, "@", -1)).when(x["kind"] == "ip", F.substring_index(low, ".", 3)).when(x["kind"] == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 5))
    return F.array(normalised(x["kind"], x["m"]), F.concat_ws("/", x["kind"], part))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def context(text: Column, s: Column, e: Column) -> Column:
    """The CONTEXT words before s, nearest first, and the CONTEXT words from e on. A window of REACH characters settles most; a word at its edge may be cut and does not count."""
    before, after = F.substr(text, F.greatest(F.lit(1), s + 1 - REACH), F.least(F.lit(REACH), s)), F.substr(text, e + 1, F.lit(REACH))
    left = _words(F.when(s > REACH, F.regexp_replace(before, f"^{LETTER}+", "")).otherwise(before))
    left = F.when((s > REACH) & (F.size(left) < CONTEXT), _words(F.substr(text, F.lit(1), s))).otherwise(left)
    more = F.length(text) > e + REACH
    right = _words(F.when(more, F.regexp_replace(after, f"{LETTER}+$", "")).otherwise(after))
    right = F.when(more & (F.size(right) < CONTEXT), _words(F.substr(text, e + 1, F.length(text)))).otherwise(right)
    return F.concat(F.slice(F.reverse(left), 1, CONTEXT), F.slice(right, 1, CONTEXT))


def with_base(docs: DataFrame) -> DataFrame:
    """docs with ``_pii_<kind>`` columns of base spans."""
    return docs.select("*", *(base_spans(F.col("text"), k).alias(f"_pii_{k}") for k in KINDS))


def _of_kind(kind: str, spans: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))


def _all(kinds=KINDS) -> Column:
    """array<struct<kind, s, e, m>> of the base columns, by kind as listed, then start."""
    return F.concat(*(_of_kind(k, f"_pii_{k}") for k in kinds)).cast("array<struct<kind:string,s:int,e:int,m:string>>")


def _key() -> Column:
    return F.sha2("text", 256)


def disclosing(based: DataFrame) -> DataFrame:
    """text_key, terms (array<struct<term, removed>>) and their places (array<struct<s, e, m, removed>>): for each different text with entities, the terms that reveal one of them. ``based`` has the text and its base spans."""
    with_entities = based.where(F.size(_all()) > 0)
    text = F.col("text")
    hit = with_entities.select("text", F.explode(_all()).alias("x"))
    contexts = hit.select(context(text, F.col("x.s"), F.col("x.e")).alias("near"), F.xxhash64("text").alias("of"), F.explode(entities(F.col("x"))).alias("entity"))
    contexts = written(contexts.select("entity", "near", F.xxhash64("near").alias("c"), "of"), "pii-contexts")
    entity = contexts.groupBy("entity").agg(F.sum(F.size("near")).alias("ne"))
    pair = contexts.select("entity", "c", "of", F.explode("near").alias("term"))
    # a context counts for one of its texts, so texts that share all of them count as one
    pair = pair.groupBy("entity", "term", "c").agg(F.count("*").alias("k"), F.min("of").alias("of"))
    pair = pair.groupBy("entity", "term", "of").agg(F.sum("k").alias("k")).groupBy("entity", "term").agg(F.sum("k").alias("nte"), F.count("*").alias("texts"))
    pair = written(pair.where(F.col("texts") >= SUPPORT), "pii-pairs")
    terms = written(pair.select("term").distinct(), "pii-terms")
    none = based.select(F.lit("").alias("text_key"), F.array().cast("array<struct<term:string,removed:boolean>>").alias("terms"), F.array().cast(PLACES).alias("places")).limit(0)
    if terms.isEmpty():
        return none
    every = based.where(text.isNotNull())
    total = every.agg(F.sum(F.regexp_count(text, F.lit(WORD)))).first()[0]
    # counted before the join, which then sees each word once (a semi-join would be moved below the counting again)
    counted = every.select(F.explode(_words(text)).alias("term")).groupBy("term").agg(F.count("*").alias("nt")).join(small(terms), "term")
    pmi = F.log(F.col("nte") * F.lit(float(total)) / (F.col("nt") * F.col("ne")))
    ratio = pmi / F.greatest(F.lit(1e-9), F.log(F.lit(float(total)) / F.col("ne")))
    bad = pair.join(counted, "term").join(entity, "entity").select("entity", "term", ratio.alias("ratio")).where(F.col("ratio") >= GENERALISE)
    bad = written(bad, "pii-bad")
    # a text meets the terms through its own words, so an entity of many texts and many terms makes no product
    own = F.array_distinct(F.flatten(F.transform(_all(), entities)))
    words_of = with_entities.select(_key().alias("text_key"), own.alias("own"), F.explode(F.array_distinct(_words(text))).alias("term"))
    worst = words_of.join(small(bad), "term").where(F.array_contains("own", F.col("entity"))).groupBy("text_key", "term").agg((F.max("ratio") >= REMOVE).alias("removed"))
    worst = written(worst, "pii-worst")
    # the terms' places: the words of the texts that have any, each met by its own text and term
    of_text = worst.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("term", "removed"))).alias("terms"))
    texts = with_entities.select(_key().alias("text_key"), "text").join(small(written(worst.select("text_key").distinct(), "pii-revealed")), "text_key", "left_semi").dropDuplicates(["text_key"])
    words = texts.select("text_key", F.explode(positions(text, WORD)).alias("x")).select("text_key", F.lower("x.m").alias("term"), "x")
    places = words.join(small(worst), ["text_key", "term"]).groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("x.s", "x.e", "x.m", "removed"))).alias("places"))
    out = written(of_text.join(places, "text_key", "left"), "pii-terms-of-texts")
    forget(contexts, pair, terms, bad, worst)
    return out


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with ``_pii_<kind>``, ``_pii_terms`` and ``_pii_term``: base spans, the terms that reveal them, and those terms' places as whole words, in any case, outside base spans."""
    based = with_base(docs)
    terms = disclosing(based)
    terms = terms.select(F.col("text_key").alias("_pii_key"), F.col("terms").alias("_pii_terms"), F.col("places").alias("_pii_places"))
    found = based.join(small(terms), F.when(F.size(_all()) > 0, _key()) == F.col("_pii_key"), "left").drop("_pii_key")
    free = F.filter(F.coalesce("_pii_places", F.array().cast(PLACES)), lambda x: ~F.exists(_all(), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return found.withColumn("_pii_term", free).drop("_pii_places")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans, their digest, and all spans joined (kind:start:end, the method's kind ``term`` last) for every row."""
    found = with_spans(docs.select("doc_id", "text"))
    term = _of_kind("term", "_pii_term")
    counts = [F.size(f"_pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(_all()), 256).alias("base_sha256"), _joined(F.concat(_all(), term)).alias("spans"), F.size("_pii_term").cast("long").alias("n_term"))


#: What stands for a span.
CLASSES = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
TERM_CLASS = "[TERM]"


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with entities replaced by their class, disclosing terms by a class word or nothing; ``n_chars``, if there, follows the text. Of overlapping spans the first (and of those the longest) stands for all."""
    cols = docs.columns
    found = with_spans(docs)
    term = F.transform("_pii_term", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.when(x["removed"], "").otherwise(TERM_CLASS).alias("by")))
    base = [F.transform(_of_kind(CLASSES[k], f"_pii_{k}"), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("by"))) for k in KINDS]
    ordered = F.array_sort(F.concat(*base, term))

    def put(acc, x):
        skip = x["s"] < acc["at"]
        piece = F.concat(F.substr(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), x["s"] - acc["at"])), x["by"])
        return F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), put, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(F.col("text"), a["at"] + 1, F.length("text"))))
    text = F.when(F.size(ordered) > 0, done).otherwise(F.col("text"))
    out = found.withColumn("_pii_text", text)
    changed = [F.col("_pii_text").alias("text") if c == "text" else F.when(F.col("_pii_text") != F.col("text"), F.length("_pii_text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in cols]
    return out.select(*changed)
