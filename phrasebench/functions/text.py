"""Text expressions; every one is a plain Column expression that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phrasebench.fixed import (
    BANK_PARTS, ERROR_TYPES, FAILURE_TYPES, LABEL_WORDS, PHRASE_BOOST, PHRASE_THRESHOLD, SHORT_WORDS, WEAK_CONTEXTS)


#: Any run of white space, beyond ASCII too.
SPACE_RUN = r"[\s\x1c-\x1f\x85\p{Z}]+"


#: Word endings to cut: ing after three letters or more, ed after three, s after four.
WORD_ENDINGS = r"\b(?:([a-z]{3,})ing|([a-z]{3,})ed|([a-z]{4,})s)\b"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_text(x: Column | str) -> Column:
    """Trimmed text, empty for null."""
    return F.coalesce(strip_all(_c(x).cast("string")), F.lit(""))


def strip_all(x: Column | str) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.regexp_replace(_c(x), rf"^{SPACE_RUN}|{SPACE_RUN}$", "")


def remove_label_words(x: Column | str, words: tuple[str, ...] = LABEL_WORDS) -> Column:
    """Cut whole words that leak the label (case-sensitive), then strip; inner double spaces stay."""
    return strip_all(F.regexp_replace(_c(x), rf"(?U)\b({'|'.join(words)})\b", ""))


def collapse_space(x: Column | str) -> Column:
    return strip_all(F.regexp_replace(_c(x), SPACE_RUN, " "))


def tokenize_ws(x: Column | str) -> Column:
    """Lower-cased white-space tokens without empties."""
    return F.array_remove(F.split(F.lower(_c(x)), SPACE_RUN), "")


def letters_only(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "[^a-zA-Z]", "")


def light_stem(x: Column | str) -> Column:
    """Cut one ending off a lower-case word: ing (over 5 letters), else ed, else s (over 4)."""
    w = _c(x)
    n = F.length(w)
    return (
        F.when((n > 5) & w.endswith("ing"), F.substring(w, F.lit(1), n - 3))
        .when((n > 4) & w.endswith("ed"), F.substring(w, F.lit(1), n - 2))
        .when((n > 4) & w.endswith("s"), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def normal_tokens(x: Column | str) -> Column:
    """White-space tokens cut to ASCII letters and stemmed; tokens left empty are dropped.

    Same words as ``light_stem(letters_only(token))`` per token, done on the whole text at once: drop
    what is neither letter nor white space, cut endings off whole words, split.
    """
    letters = F.regexp_replace(F.lower(_c(x)), r"[^a-z\s\x1c-\x1f\x85\p{Z}]", "")
    stems = F.regexp_replace(letters, WORD_ENDINGS, "$1$2$3")
    return F.array_remove(F.split(stems, SPACE_RUN), "")


def padded_run(tokens: Column | str) -> Column:
    """Tokens as one string with a space on both sides, so a token run is a substring."""
    return F.concat(F.lit(" "), F.array_join(_c(tokens), " "), F.lit(" "))


def phrase_score(phrase_tokens: Column | str, query_tokens: Column | str) -> Column:
    """1.0 when the phrase is a contiguous token run of the query, else 0.0 (empty phrase: 0.0)."""
    p, q = _c(phrase_tokens), _c(query_tokens)
    hit = (F.size(p) > 0) & F.contains(padded_run(q), padded_run(p))
    return F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))


def phrase_boost(score: Column | str, boost: float = PHRASE_BOOST, threshold: float = PHRASE_THRESHOLD) -> Column:
    return F.when(_c(score) >= threshold, F.lit(boost)).otherwise(F.lit(0.0))


def bank_text(entity, meaning, paraphrase, explanation, usage) -> Column:
    """Labelled template with the entity named twice, white space collapsed."""
    values = (entity, entity, meaning, paraphrase, explanation, usage)
    return collapse_space(F.concat(*[
        c for name, v in zip(BANK_PARTS, values) for c in (F.lit(name), safe_text(v))]))


def join_nonempty(*parts: Column | str, sep: str = " | ") -> Column:
    return F.concat_ws(sep, *[F.nullif(strip_all(_c(p)), F.lit("")) for p in parts])


def role_prefix(x: Column | str, role: str) -> Column:
    return F.concat(F.lit(f"{role}: "), _c(x))


def candidate_text(entity: Column | str, meaning: Column | str) -> Column:
    return F.concat(_c(entity), F.lit(" | "), F.coalesce(_c(meaning), F.lit("")))


def parse_list(x: Column | str) -> Column:
    """A list stored as text; text that is no list becomes a one-element list."""
    return F.coalesce(F.from_json(_c(x), "array<string>"), F.array(_c(x)))


def word_set(x: Column | str) -> Column:
    return F.array_distinct(tokenize_ws(x))


def failure_type(gold: Column | str, pred: Column | str) -> Column:
    """Shared word → lexical; both at most three distinct words → short; else semantic."""
    g, p = word_set(gold), word_set(pred)
    return (
        F.when(F.size(F.array_intersect(g, p)) > 0, FAILURE_TYPES[0])
        .when((F.size(g) <= SHORT_WORDS) & (F.size(p) <= SHORT_WORDS), FAILURE_TYPES[1])
        .otherwise(FAILURE_TYPES[2])
    )


def error_type(gold: Column | str, preds: list[Column]) -> Column:
    """Correct at rank 1, near miss at ranks 2-3, else hard error."""
    g = _c(gold)
    later = F.coalesce(g == preds[1], F.lit(False)) | F.coalesce(g == preds[2], F.lit(False))
    return (
        F.when(F.coalesce(g == preds[0], F.lit(False)), ERROR_TYPES[0])
        .when(later, ERROR_TYPES[1]).otherwise(ERROR_TYPES[2])
    )


def weak_context_rows(entity: Column | str) -> Column:
    """Four (text, label) rows of a short context around an entity; explode the result."""
    e = _c(entity)
    return F.array(*[
        F.struct(F.concat(F.lit(before), e, F.lit(after)).alias("text"), F.lit(y).alias("label"))
        for before, after, y in WEAK_CONTEXTS])
