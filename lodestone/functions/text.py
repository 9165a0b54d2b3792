"""Text expressions built from Spark SQL functions only.

Each function takes a column and gives back a column, so a plan that uses them
keeps column pruning and code generation and starts no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token, entity and citation patterns that the results rest on.
TOKEN_PATTERN = r"[\p{L}\p{N}_'-]+"
ENTITY_PATTERN = (
    r"(?:^|[^\p{L}\p{N}_])"
    r"([A-Z](?:[\p{L}\p{N}_'-]+\s+[A-Z]){0,3}[\p{L}\p{N}_'-]*[\p{L}\p{N}_])"
)
SENTENCE_BREAK = r"(?<=[.!?])\s+"
CITATION_PATTERN = r"^\[?[Pp]?(\d+)\s*[:;,/-]\s*[Ss]?(\d+)\]?$"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES_PATTERN = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"
ANSWER_KEYS = ("answer", "result", "response")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def casefold(text: Column | str) -> Column:
    """Lower case plus the two foldings that matter for running text (ß and final sigma)."""
    return F.replace(
        F.replace(F.lower(_col(text)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ")
    )


def tokens(text: Column | str) -> Column:
    """Unicode word tokens in order, repeats kept."""
    return F.regexp_extract_all(casefold(text), F.lit(TOKEN_PATTERN), F.lit(0))


def normalize(text: Column | str) -> Column:
    return F.array_join(tokens(text), " ")


def token_set(text: Column | str) -> Column:
    return F.array_distinct(tokens(text))


def estimate_tokens(text: Column | str) -> Column:
    """A quarter of the code points, rounded up, never below one."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(_col(text)) / 4)).cast("long")


def full_text(title: Column | str, text: Column | str) -> Column:
    return F.btrim(F.concat(_col(title), F.lit(". "), _col(text)), F.lit(" \n\t\r"))


def overlap_ratio(left: Column | str, right: Column | str) -> Column:
    """Share of the distinct left tokens that occur on the right (asymmetric)."""
    left, right = _col(left), _col(right)
    return F.size(F.array_intersect(left, right)) / F.greatest(
        F.lit(1), F.size(F.array_distinct(left))
    )


def squeeze_casefold(text: Column | str) -> Column:
    """Case-folded text with every whitespace run (Unicode included) as one space."""
    parts = F.split(casefold(text), r"(?U)\s+")
    return F.array_join(F.filter(parts, lambda part: part != ""), " ")


def normalize_answer(text: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces."""
    bare = F.translate(F.lower(_col(text)), ASCII_PUNCTUATION, "")
    bare = F.regexp_replace(bare, ARTICLES_PATTERN, " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def answer_tokens(text: Column | str) -> Column:
    return F.filter(F.split(normalize_answer(text), " "), lambda part: part != "")


def surface_entities(text: Column | str) -> Column:
    """Capitalised surface forms, up to four words each, as they stand in the text."""
    return F.regexp_extract_all(_col(text), F.lit(ENTITY_PATTERN), F.lit(1))


def normalized_entities(text: Column | str) -> Column:
    """Sorted distinct normalised surface forms longer than two characters."""
    named = F.transform(surface_entities(text), lambda value: normalize(value))
    return F.array_sort(
        F.array_distinct(F.filter(named, lambda value: F.char_length(value) > 2))
    )


def provided_entities(entities: Column | str) -> Column:
    named = F.transform(_col(entities), lambda value: normalize(value))
    return F.array_sort(F.array_distinct(F.filter(named, lambda value: value != "")))


def sentences(text: Column | str) -> Column:
    """Sentences cut after . ! ?; a text with none is its own single sentence."""
    text = _col(text)
    parts = F.filter(
        F.transform(F.split(text, SENTENCE_BREAK), lambda part: F.btrim(part, F.lit(" \n\t\r"))),
        lambda part: part != "",
    )
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def parse_citation(reference: Column | str) -> Column:
    """``[P2:S0]``-style reference to struct(passage_no, sentence_no), null when malformed."""
    reference = F.btrim(_col(reference), F.lit(" \n\t\r"))
    return F.when(
        F.regexp_like(reference, F.lit(CITATION_PATTERN)),
        F.struct(
            F.regexp_extract(reference, CITATION_PATTERN, 1).cast("int").alias("passage_no"),
            F.regexp_extract(reference, CITATION_PATTERN, 2).cast("int").alias("sentence_no"),
        ),
    )


def resolve_citation(
    reference: Column | str, passage_ids: Column | str, sentence_counts: Column | str
) -> Column:
    """Citation to (passage_id, sentence_no): passages from 1, sentences from 0, range-checked."""
    passage_ids, sentence_counts = _col(passage_ids), _col(sentence_counts)
    parsed = parse_citation(reference)
    number, sentence = parsed["passage_no"], parsed["sentence_no"]
    return F.when(
        (number >= 1)
        & (number <= F.size(passage_ids))
        & (sentence < F.try_element_at(sentence_counts, F.greatest(number, F.lit(1)))),
        F.struct(
            F.try_element_at(passage_ids, F.greatest(number, F.lit(1))).alias("passage_id"),
            sentence.alias("sentence_no"),
        ),
    )


def extract_answer(response: Column | str) -> Column:
    """Answer field of a reader's JSON reply; a reply that is not JSON is the answer itself."""
    response = _col(response)
    parsed = F.try_parse_json(response)
    found = F.coalesce(
        *[F.try_variant_get(parsed, f"$.{key}", "string") for key in ANSWER_KEYS], F.lit("")
    )
    return F.btrim(F.when(parsed.isNull(), response).otherwise(found), F.lit(" \n\t\r"))


def stable_passage_id(title: Column | str, text: Column | str) -> Column:
    """Content id: equal for texts that differ only in case or whitespace."""
    content = F.concat(squeeze_casefold(title), F.lit("\u0000"), squeeze_casefold(text))
    return F.concat(F.lit("p_"), F.substring(F.sha1(content.cast("binary")), 1, 16))


def hash_bucket(token: Column | str, buckets: int) -> Column:
    """Bucket of a token from its md5, the same in every process and engine."""
    prefix = F.substring(F.md5(_col(token).cast("binary")), 1, 8)
    return F.pmod(F.conv(prefix, 16, 10).cast("long"), F.lit(buckets)).cast("int")
