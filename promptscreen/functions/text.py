"""Column expressions on prompt text (all JVM-side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptscreen.constants import CLASSIFICATION_PREFIX, TOKEN_PATTERN


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_text(c) -> Column:
    """True when the string holds a non-whitespace character (Python ``strip``)."""
    return col_(c).rlike(r"(?U)\S")


def tokens(c, pattern: str = TOKEN_PATTERN) -> Column:
    """Lower-cased word tokens: runs of two or more letters, digits or ``_``."""
    return F.regexp_extract_all(F.lower(col_(c)), F.lit(pattern), 0)


def remove_stop_words(toks, stop_words) -> Column:
    """Drop stop words but keep repeats and order (unlike ``array_except``)."""
    if not stop_words:
        return col_(toks)
    return F.filter(col_(toks), lambda t: ~t.isin(*stop_words))


def ngrams(toks, n_max: int = 2) -> Column:
    """Unigrams followed by bigrams (space-joined) of a token array. The array is
    bound by a lambda: named more than once, a text would be cut into tokens as
    often."""
    t = col_(toks)
    if n_max == 1:
        return t
    if n_max != 2:
        raise ValueError("only 1- and 2-grams are supported")
    return F.get(F.transform(F.array(t), _with_bigrams), F.lit(0))


def _with_bigrams(t) -> Column:
    k = F.greatest(F.size(t) - 1, F.lit(0))
    bigrams = F.zip_with(F.slice(t, 1, k), F.slice(t, 2, k),
                         lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(t, bigrams)


def with_prefix(c, prefix: str = CLASSIFICATION_PREFIX) -> Column:
    """Instruction prefix in front of the prompt (stage-2 model input)."""
    return F.concat(F.lit(prefix), col_(c))


def truncate_tokens(toks, max_tokens: int) -> Column:
    return F.slice(col_(toks), 1, max_tokens)


def replace_first(text, target, replacement) -> Column:
    """Replace the first substring occurrence of ``target`` in ``text``.

    Null when ``target`` does not occur (callers drop those rows).
    """
    t, tg, rp = col_(text), col_(target), col_(replacement)
    pos = F.instr(t, tg)
    return F.when(pos > 0, F.overlay(t, rp, pos, F.length(tg)))


def lemma_name(c) -> Column:
    """Lexicon entry as a replacement word: ``_`` becomes a space, lower case."""
    return F.lower(F.translate(col_(c), "_", " "))


def separators(c, pattern: str = TOKEN_PATTERN) -> Column:
    """The pieces of the lower-cased text between tokens (one more than tokens)."""
    return F.split(F.lower(col_(c)), pattern, -1)


def rebuild_text(seps, toks) -> Column:
    """Text from separator pieces and (possibly replaced) tokens: s0 t0 s1 t1 ... sn."""
    s, t = col_(seps), col_(toks)
    body = F.zip_with(t, F.slice(s, 2, F.greatest(F.size(t), F.lit(0))),
                      lambda a, b: F.concat(a, b))
    return F.concat(F.element_at(s, 1), F.array_join(body, ""))
