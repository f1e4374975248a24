"""Name normalisation, romanisation folding, blocking keys and similarity."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The romanisation of Cyrillic letters.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "ґ": "g", "д": "d", "е": "e", "ё": "yo", "є": "ye", "ж": "zh", "з": "z", "и": "i", "і": "i", "ї": "yi", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n",
    "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ў": "w", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
# Words that say nothing about who a party is.
STOP = (
    "llc", "ltd", "limited", "jsc", "ojsc", "pjsc", "cjsc", "ooo", "oao", "zao", "ao", "pao", "inc", "corp", "corporation", "co", "company", "group", "gmbh", "sa", "plc", "llp", "the", "of", "and", "de",
    "la", "el", "al", "fzco", "fze", "jv", "ltda", "srl", "or", "also", "known", "as",
)
# Spellings that romanisations vary, replaced in this order.
FOLDS = (
    ("shch", "sh"), ("sch", "sh"), ("tch", "ch"), ("dzh", "j"), ("zh", "j"), ("kh", "h"), ("ph", "f"), ("th", "t"), ("ck", "k"), ("ks", "x"), ("cz", "ch"), ("iy", "i"), ("yy", "i"), ("ii", "i"),
    ("yi", "i"), ("ij", "i"), ("ye", "e"), ("ie", "e"), ("yo", "o"), ("jo", "o"), ("yu", "u"), ("ju", "u"), ("ya", "a"), ("ja", "a"), ("w", "v"), ("q", "k"), ("y", "i"),
)
# Weights of the similarity.
EXPLAINED, COVERED, INITIAL = 0.85, 0.15, 0.9


def unaccented() -> dict[str, str]:
    """What letters of the Latin blocks, letter-like signs, ligatures and full-width forms are in plain ASCII, by Unicode's
    own compatibility decomposition without combining marks."""
    out = {}
    for first, last in ((0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2100, 0x214F), (0xFB00, 0xFB06), (0xFF01, 0xFF5E)):
        for c in map(chr, range(first, last + 1)):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x)).lower()
            plain = "".join(x if x.isascii() else " " for x in plain)
            if plain.strip() and plain != c:
                out[c] = plain
    return out


def normalized(name: Column | str) -> Column:
    """Lower-case ASCII words: romanised, unaccented, without punctuation, & as and; null as empty. Built-in functions only;
    names of ASCII letters skip all but the last steps."""
    given = F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(""))
    low = F.lower(given)
    maps = CYRILLIC | unaccented()
    latin = low
    for c, plain in maps.items():
        if len(plain) > 1:
            latin = F.replace(latin, F.lit(c), F.lit(plain))
    single = {c: p for c, p in maps.items() if len(p) == 1}
    gone = "".join(c for c, p in maps.items() if not p)
    latin = F.regexp_replace(F.translate(latin, "".join(single) + gone, "".join(single.values())), r"\p{M}+", "")
    plain = F.when(given.rlike(r"[^\x00-\x7F]"), latin).otherwise(low)
    spaced = F.replace(F.replace(plain, F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    return F.trim(F.regexp_replace(spaced, "[^a-z0-9]+", " "))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: (t != "") & ~t.isin(*STOP))


#: C before anything but h sounds like k; a letter counts once in a row.
HARD_C, DOUBLED = "c(?!h)", r"(.)\1+"


def fold(token: Column) -> Column:
    for a, b in FOLDS:
        token = F.replace(token, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(token, HARD_C, "k"), DOUBLED, "$1")


def folded_tokens(name: Column) -> Column:
    return F.transform(tokens(normalized(name)), fold)


def keys_of(folded: Column) -> Column:
    """Blocking keys: short tokens whole; else first three and last three letters, and three consonants where there are."""

    def of(t: Column) -> Column:
        bones = F.regexp_replace(t, "[aeiou]", "")
        long = F.array(F.concat(F.lit("p:"), F.left(t, F.lit(3))), F.concat(F.lit("s:"), F.right(t, F.lit(3))), F.when(F.length(bones) >= 3, F.concat(F.lit("c:"), F.left(bones, F.lit(3)))))
        return F.when(F.length(t) < 3, F.array(F.concat(F.lit("w:"), t))).otherwise(long)

    return F.array_distinct(F.filter(F.flatten(F.transform(folded, of)), lambda k: k.isNotNull()))


def script_of(name: Column) -> Column:
    """latin, cyrillic, or other: other if any letter is of neither or there is no letter."""
    other = name.rlike(r"[\p{L}&&[^\p{IsLatin}\p{IsCyrillic}]]") | ~name.rlike(r"\p{L}")
    return F.when(name.isNull() | other, "other").when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


@lru_cache(maxsize=1 << 17)
def jaro_winkler(a: str, b: str, scale: float = 0.1, boost: float = 0.7) -> float:
    """Jaro similarity, and for those above boost a bonus for up to four equal first letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, hit_a = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                hit_a.append(c)
                break
    m = len(hit_a)
    if not m:
        return 0.0
    hit_b = [c for c, f in zip(b, free, strict=True) if not f]
    swapped = sum(x != y for x, y in zip(hit_a, hit_b, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= boost:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * scale * (1 - jaro)


def token_similarity(query, listed) -> float:
    """Tokens aligned one to one, best pairs first; of equal pairs the one further back. An initial matches its word."""
    if query is None or listed is None or not len(query) or not len(listed):
        return 0.0
    sims = np.array([[(INITIAL if q[:1] == n[:1] else 0.0) if min(len(q), len(n)) == 1 else jaro_winkler(q, n) for n in listed] for q in query])
    total, used = 0.0, 0
    while used < min(sims.shape):
        flat = sims.shape[0] * sims.shape[1] - 1 - int(np.argmax(sims[::-1, ::-1]))
        i, j = divmod(flat, sims.shape[1])
        total += sims[i, j]
        sims[i, :], sims[:, j] = -1.0, -1.0
        used += 1
    return EXPLAINED * total / len(query) + COVERED * used / len(listed)


@F.pandas_udf(T.DoubleType())
def similarity(query: pd.Series, listed: pd.Series) -> pd.Series:
    return pd.Series([token_similarity(q, n) for q, n in zip(query, listed, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")
