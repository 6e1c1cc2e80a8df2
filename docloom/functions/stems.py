"""A suffix stemmer for English words, as one column expression, and the words that say nothing in a search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import col

# Endings and what takes their place where a syllable stands before, longest first.
REPLACED = {
    "ational": "ate", "ization": "ize", "iveness": "ive", "fulness": "ful", "ousness": "ous", "biliti": "ble", "tional": "tion", "lessli": "less", "alism": "al", "aliti": "al", "iviti": "ive",
    "ation": "ate", "entli": "ent", "ousli": "ous", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al",
}
REPLACED_NEXT = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}  # the same, in what that leaves
# Endings that go where two syllables stand before, longest first.
DROPPED = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
# Consonants that a participle doubles.
DOUBLED = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
# Words of a search that carry no meaning.
SEARCH_STOP = ["a", "about", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "not", "of", "on", "or", "our", "she", "so", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "we", "were", "what", "when", "where", "which", "who", "why", "will", "with", "you", "your"]
ONE_SYLLABLE = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
TWO_SYLLABLES = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
LEADING = 2  # letters at the begin of a word that its stem surely has too


def sure_begin(term: str) -> str:
    """What every word begins with whose stem is ``term``: the stem, without what the rules may have put at its end (e, i, ble)."""
    if len(term) <= LEADING:
        return term
    kept = max((k for k in ("ble", "bl") if term.endswith(k)), key=len, default="")
    return term[: len(term) - len(kept) + 1] if kept else term[:-1] if term[-1] in "ei" else term


def _ending(w: Column, size: int) -> Column:
    return F.left(w, F.length(w) - size)


def _table(w: Column, endings: dict[str, str], before: str) -> Column:
    """The longest ending of the table that a word has is replaced, if what is left of the word looks like ``before``."""
    out = w
    for old, new in reversed(endings.items()):
        rest = _ending(w, len(old))
        out = F.when(w.endswith(old), F.when(rest.rlike(before), F.concat(rest, F.lit(new))).otherwise(w)).otherwise(out)
    return out


def _step(w: Column, use) -> Column:
    """``use`` of a word, which is worked out once."""
    return F.get(F.transform(F.array(w), use), F.lit(0))


def stem(c: Column | str) -> Column:
    """A lower-case word without its English endings; words of up to ``LEADING`` letters stay, and so do its first letters."""
    plural = lambda w: F.when(w.endswith("sses") | w.rlike("..ies$"), _ending(w, 2)).when(w.rlike("[aeiouy].*[^su]s$"), _ending(w, 1)).otherwise(w)
    cut = lambda w: F.when(w.rlike("[aeiouy].*ing$"), F.struct(_ending(w, 3).alias("w"), F.lit(True).alias("cut"))).when(w.endswith("eed"), F.struct(F.when(_ending(w, 3).rlike(ONE_SYLLABLE), _ending(w, 1)).otherwise(w).alias("w"), F.lit(False).alias("cut"))).when(w.rlike("[aeiouy].*ed$"), F.struct(_ending(w, 2).alias("w"), F.lit(True).alias("cut"))).otherwise(F.struct(w.alias("w"), F.lit(False).alias("cut")))
    doubled = lambda w: reduce(lambda a, b: a | b, (w.endswith(x) for x in DOUBLED))
    mended = lambda s: F.when(~s["cut"], s["w"]).when(s["w"].rlike("(at|bl|iz)$"), F.concat(s["w"], F.lit("e"))).when(doubled(s["w"]), _ending(s["w"], 1)).otherwise(s["w"])
    soft = lambda w: F.when(w.rlike("..[^aeiouy]y$|.[^aeiouy]y$") & (F.length(w) > LEADING), F.concat(_ending(w, 1), F.lit("i"))).otherwise(w)
    ion = lambda w: F.when(w.rlike("[st]ion$"), F.when(_ending(w, 3).rlike(TWO_SYLLABLES), _ending(w, 3)).otherwise(w)).otherwise(_table(w, dict.fromkeys(DROPPED, ""), TWO_SYLLABLES))
    last = lambda w: F.when(w.rlike("[^e]e$") & _ending(w, 1).rlike(TWO_SYLLABLES), _ending(w, 1)).otherwise(w)
    steps = [plural, cut, mended, soft, lambda w: _table(w, REPLACED, ONE_SYLLABLE), lambda w: _table(w, REPLACED_NEXT, ONE_SYLLABLE), ion, last]
    w = col(c)
    return F.when(F.length(w) <= LEADING, w).otherwise(reduce(_step, steps, w))
