"""Personal data and secrets replaced by surrogates: keyed, of the same kind and form, one for one.

Detected kinds: e-mail addresses, phone numbers (with a country code, or in the North American layout), IPv4 and IPv6
addresses, payment cards (Luhn), US social security numbers, IBANs (mod 97), secrets (keys by prefix, and assigned tokens),
and names: the words after an honorific, and the same words elsewhere in that text. An entity's canonical form decides its
surrogate, by a keyed hash and an attempt number, so every occurrence in any document gets the same one, laid out as the
occurrence is. The corpus's distinct entities are checked together: a surrogate must differ from every other surrogate and
from every real entity of its kind, else the entity goes on to its next attempt. A name's words are one kind for each script,
so a word has one surrogate whatever stands around it; whether that is a surname or a given name, and of which gender, is
settled over all texts.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, unused

#: Honorifics by the gender they tell.
HONORIFICS = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин", "κ", "κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Signora", "г-жа", "госпожа", "κα", "κυρία"],
    "u": ["Dr", "Prof", "Professor", "Doctor"],
}
#: Given names whose gender is known whatever the honorific.
GIVEN = {
    "f": "mary anna anne emma julia laura maria sarah sophie claire marie camille elena lucia carmen sofia greta helga ingrid ursula ольга анна елена мария наталья ελένη μαρία".split(),
    "m": "john james paul peter thomas michael david pierre jean louis antoine carlos jose juan pablo hans karl otto stefan uwe иван сергей дмитрий алексей павел γιώργος νίκος".split(),
}
#: The country calling codes of one and of two digits; all others have three.
ONE_DIGIT, TWO_DIGITS = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Syllables that surrogate names are made of, and their endings by gender, per script.
SYLLABLES = {
    "latin": ("ba be bo da de do fa fe ga ka ke la le lo ma me mi mo na ne no pa pe ra re ri ro sa se ta te ti to va ve vi".split(), {"f": ["na", "la", "ria", "sa"], "m": ["n", "ro", "no", "rd"], "u": ["ren", "lis", "rin"], "s": ["ner", "man", "son", "let", "ret"]}),
    "cyrillic": ("ба бо ва ве га да де до за ка ко ла ле ма ми мо на не но па по ра ре ро са се та ти то".split(), {"f": ["на", "ла", "рия"], "m": ["н", "рий", "слав"], "u": ["рен", "лис"], "s": ["нов", "рин", "ков", "ский"]}),
    "greek": ("βα βε γα δα δε κα κο λα λε μα με μι να νε νο πα πε ρα ρε ρο σα τα τε".split(), {"f": ["να", "ρία", "λη"], "m": ["νος", "ρης", "λης"], "u": ["ρις", "νις"], "s": ["δης", "νου", "κος", "λης"]}),
}
TITLE = {name: g for g, names in HONORIFICS.items() for name in names}
NAME_PART = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][\w’'-]*[^\W\d_]"
NAME_WORD = re.compile(rf"\b{NAME_PART}")
NAME = re.compile(rf"\b({'|'.join(sorted(map(re.escape, TITLE), key=len, reverse=True))})\.?[  ]({NAME_PART}(?:[  ]{NAME_PART}){{0,2}})")
EMAIL = re.compile(r"[\w+%-][\w.+%-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}\b")
NUMBER = re.compile(r"(?<![\w+])(?<!\d\.)(?:(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-/]?\d{2,4}){1,5})|(?P<national>\([2-9]\d\d\) ?\d{3}[-. ]\d{4}|[2-9]\d\d([-.])\d{3}\3\d{4})|(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))|(?P<ssn>\d{3}-\d{2}-\d{4})|(?P<card>\d(?:[ -]?\d){12,18}))(?![\w]|\.\d)")
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39}(?![\w:])")
SECRET = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,})\b")
ASSIGNED = re.compile(r"(?i)\b(?:api[_-]?key|secret|token|passw(?:or)?d|access[_-]?key|auth)\b[\"']?\s*[:=]\s*[\"']?(?P<v>[A-Za-z0-9_+/.=-]{12,})")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
PREFIXES = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "sk-")
#: From so many attempts on, surrogates grow by a character, so that even a full domain ends in distinct ones.
GROW = 12


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + it pass."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 - i % 2)
        total += x - 9 * (x > 9)
    return str(-total % 10)


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def country_code(digits: str) -> str:
    return digits[:1] if digits[0] in ONE_DIGIT else digits[:2] if digits[:2] in TWO_DIGITS else digits[:3]


def script_of(word: str) -> str:
    if any("Ѐ" <= c <= "ӿ" for c in word):
        return "cyrillic"
    return "greek" if any("Ͱ" <= c <= "Ͽ" for c in word) else "latin"


def told_gender(word: str) -> str:
    return next((g for g, names in GIVEN.items() if word in names), "")


def named(text: str) -> list[tuple[int, int, str, str, str]]:
    """The words of names after honorifics, and the same words, with a capital, wherever else they stand in the text."""
    out, words = [], {}
    for m in NAME.finditer(text):
        parts = list(re.finditer(NAME_PART, m[2]))
        for k, p in enumerate(parts):
            word = p[0].lower()
            form = "" if k == len(parts) - 1 else TITLE[m[1]]
            words.setdefault(word, f"name_{script_of(word)}")
            out.append((m.start(2) + p.start(), m.start(2) + p.end(), words[word], word, form))
    if words:
        held = {x[0] for x in out}
        out += [(m.start(), m.end(), words[m[0].lower()], m[0].lower(), "") for m in NAME_WORD.finditer(text) if m.start() not in held and m[0].lower() in words]
    return out


def detect(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical form, form), in order and without overlaps; of overlapping finds the earlier, then the
    longer. The form is the gender that an honorific tells of a given name, else empty."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower(), "") for m in EMAIL.finditer(text)]
    for m in NUMBER.finditer(text):
        kind, value = next(k for k in ("phone", "national", "ip", "ssn", "card") if m[k]), m[0]
        digits = re.sub(r"\D", "", value)
        if kind == "card" and (len(set(digits)) == 1 or luhn_digit(digits[:-1]) != digits[-1]):
            continue
        if kind == "phone" and not 8 <= len(digits) <= 15:
            continue
        if kind == "national":
            kind, digits = "phone", f"1{digits}"
        found.append((m.start(), m.end(), kind, value if kind == "ip" else digits, ""))
    if ":" in text:
        for m in IPV6.finditer(text):
            try:
                if m[0].replace("::", ":").count(":") > 1:
                    found.append((m.start(), m.end(), "ipv6", str(ipaddress.IPv6Address(m[0])), ""))
            except ValueError:
                continue
    if "AKIA" in text or "_" in text or "-" in text:
        found += [(m.start(), m.end(), "secret", m[0], "") for m in SECRET.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start("v"), m.end("v"), "secret", m["v"], "") for m in ASSIGNED.finditer(text) if any(c.isdigit() for c in m["v"])]
    for m in IBAN.finditer(text):
        value = m[0].replace(" ", "")
        if 15 <= len(value) <= 34 and mod97(value) == 1:
            found.append((m.start(), m.end(), "iban", value, ""))
    found += named(text)
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def usual_form(kind: str, canon: str) -> str:
    """The form that needs no lookup: names are surnames, but for given names whose gender is known."""
    return (told_gender(canon) or "s") if kind.startswith("name_") else ""


def settled_form(kind: str, canon: str, told: set[str]) -> str:
    """The form by what honorifics told of a word in all texts: a given name is of that gender, of none if they differ."""
    if not kind.startswith("name_") or told_gender(canon) or not told - {""}:
        return usual_form(kind, canon)
    told = told & {"m", "f"}
    return told.pop() if len(told) == 1 else "u"


class Stream:
    """Keyed pseudo-random choices for one entity and attempt."""

    def __init__(self, key: bytes, *what: object):
        self.seed, self.n, self.pool = blake2b("\x1f".join(map(str, what)).encode(), key=key[:64], digest_size=32).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += blake2b(self.seed, salt=self.n.to_bytes(8, "little"), digest_size=64).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:8], "little"), self.pool[8:]
        return x % n

    def pick(self, items):
        return items[self.below(len(items))]

    def like(self, text: str, hexadecimal: bool = False) -> str:
        """Letters and digits replaced by others of their class."""
        out = []
        for c in text:
            if hexadecimal and c.isalnum():
                x = "0123456789abcdef"[self.below(16)]
                out.append(x.upper() if c.isupper() else x)
            elif c.isdigit():
                out.append("0123456789"[self.below(10)])
            elif c.isalpha():
                x = "abcdefghijklmnopqrstuvwxyz"[self.below(26)]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def like_ip(s: Stream, canon: str, attempt: int) -> str:
    """A private address for a private one, of the same network while there is room; a public one for a public one."""
    old = ipaddress.IPv4Address(canon)
    if old.is_private:
        head = next((p for p in ("192.168.", "127.", "169.254.") if canon.startswith(p)), "10.") if attempt <= GROW else "10."
        return head + ".".join(str(1 + s.below(254)) for _ in range(3 - head.count(".") + 1))
    while True:
        new = ".".join(str(1 + s.below(254)) for _ in range(4))
        if ipaddress.IPv4Address(new).is_global:
            return new


def surrogate(key: bytes, kind: str, canon: str, attempt: int, form: str = "") -> str:
    """The canonical form of the surrogate."""
    s = Stream(key, kind, canon, attempt)
    more = max(0, attempt - GROW)
    if kind == "email":
        local, _, domain = canon.partition("@")
        labels = domain.split(".")
        d = Stream(key, "domain", domain)  # one domain, one surrogate domain, under the reserved name example
        return f"{s.like(local)}{s.like('a' * more)}@{'.'.join([*(d.like(x) for x in labels[:-2]), 'example', labels[-1] if labels[-1] in ('com', 'net', 'org') else 'org'])}"
    if kind == "phone":
        code = country_code(canon)
        return code + s.like("0" * (len(canon) - len(code) + more))
    if kind == "ip":
        return like_ip(s, canon, attempt)
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(int(ipaddress.IPv6Address(canon)) >> 112 << 112 | sum(s.below(2**16) << 16 * k for k in range(7))))
    if kind == "ssn":
        return s.like(canon)
    if kind == "card":
        body = canon[0] + s.like(canon[1:-1])
        return body + luhn_digit(body)
    if kind == "iban":
        body = s.like(canon[4:])
        return f"{canon[:2]}{98 - mod97(canon[:2] + '00' + body):02d}{body}"
    if kind == "secret":
        head = next((p for p in PREFIXES if canon.startswith(p)), "")
        return head + s.like(canon[len(head) :] + "a" * more, hexadecimal=bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon)))
    syllables, endings = SYLLABLES[kind.removeprefix("name_")]
    return "".join(s.pick(syllables) for _ in range(2 + more + s.below(2))) + s.pick(endings[form or usual_form(kind, canon)])


def laid_out(kind: str, value: str, canon: str, new: str) -> str:
    """The canonical surrogate in the layout of an occurrence: its separators and its case."""
    if kind in ("phone", "ssn", "card", "iban"):
        chars = iter(new[len(canon) - sum(c.isalnum() for c in value) :])  # a national number has no country code
        out = [next(chars, "") if c.isalnum() else c for c in value]
        return "".join(out) + "".join(chars)
    if kind == "email" and value.upper() == value:
        return new.upper()
    if kind.startswith("name_"):
        return new.upper() if value.isupper() and len(value) > 1 else new.capitalize()
    return new


def rewrite(text: str, key: bytes, settled: Callable[[str, str], tuple[int, str]]) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and (kind, start, end) of each there; settled gives an entity's attempt and form."""
    out, spans, at, size = [], [], 0, 0
    for start, end, kind, canon, _ in detect(text):
        new = laid_out(kind, text[start:end], canon, surrogate(key, kind, canon, *settled(kind, canon)))
        out += [text[at:start], new]
        size += start - at
        spans.append((kind, size, size + len(new)))
        size, at = size + len(new), end
    return "".join([*out, text[at:]]), spans


def entities(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The distinct (kind, canon, form) of all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = sorted({x[2:] for t in batch.column(0).to_pylist() if t for x in detect(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], pa.string()) for k in range(3)], ["kind", "canon", "told"])

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, canon, told = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([settled_form(k, c, set(t)) for k, c, t in zip(kind, canon, told, strict=True)], pa.string())], ["kind", "canon", "form"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(work, "kind string, canon string, told string")
    return found.groupBy("kind", "canon").agg(F.collect_set("told").alias("told")).mapInArrow(form, "kind string, canon string, form string")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon, attempt, form, surrogate) for distinct entities (kind, canon, form): surrogates are distinct within a
    kind, and none is an entity.

    Each round gives the losers of the last one their next attempt; of several entities with one surrogate, one that had it
    before stays, else the smallest. Rounds go on until there are no losers.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([surrogate(key, *x) for x in rows], pa.string())], ["kind", "canon", "attempt", "form", "surrogate"])

    schema = "kind string, canon string, attempt int, form string, surrogate string"
    real = found.select("kind", F.col("canon").alias("surrogate"))
    settled, pending = None, found.select("kind", "canon", F.lit(0).alias("attempt"), "form")
    while True:
        tried = pending.mapInArrow(work, schema).withColumn("rank", F.lit(1))
        both = materialize(tried if settled is None else tried.unionByName(settled.withColumn("rank", F.lit(0))), "pii-tried")
        free = both.join(real, ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min(F.struct("rank", "canon")).alias("w")).select("kind", F.col("w.canon").alias("canon"))
        settled = materialize(both.join(first, ["kind", "canon"], "left_semi").drop("rank"), "pii-settled")
        pending = both.join(settled.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"), "form")
        pending = materialize(pending, "pii-pending")
        if pending.isEmpty():
            return settled


def unusual(settled: DataFrame) -> DataFrame:
    """(kind, canon, attempt, form) of the entities that need a lookup: not at their first attempt or usual form."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, canon, attempt, form = (c.to_pylist() for c in b.columns)
            yield b.filter(pa.array([a > 0 or f != usual_form(k, c) for k, c, a, f in zip(kind, canon, attempt, form, strict=True)], pa.bool_()))

    return settled.select("kind", "canon", "attempt", "form").mapInArrow(work, "kind string, canon string, attempt int, form string")


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
LOOKUP = "array<struct<kind:string,canon:string,attempt:int,form:string>>"


def replace(docs: DataFrame, key: bytes, *, text_col: str = "text", entities_col: str = "pii_entities", broadcast_rows: int = 20_000) -> DataFrame:
    """docs's columns with surrogates in the text, plus entities_col: array of (kind, start, end) in the new text. If docs
    has a column of that name, it stays, and the new one has underscores before its name.

    Null and empty texts stay as they are, with no entities. Texts are read whole, whatever their length. Rows, repeats
    included, are kept as they are otherwise. Empty table: empty result. An entity settled at its first attempt and usual
    form needs no lookup. The others are few: up to broadcast_rows of them go to every task; beyond that, each document
    gets its own by a join on the document's entities, and its text is shuffled.
    """
    spark, names = docs.sparkSession, docs.columns
    odd = materialize(unusual(assign(materialize(entities(docs, text_col=text_col), "pii-entities"), key)), "pii-odd")
    few = {(r["kind"], r["canon"]): (r["attempt"], r["form"]) for r in odd.limit(broadcast_rows + 1).collect()}
    if len(few) <= broadcast_rows:
        src = docs.select("*", F.lit(None).cast(LOOKUP).alias(unused(docs, "looked_up")))
    else:
        few, src = {}, with_attempts(docs, odd, text_col)
    held = spark.sparkContext.broadcast(few)
    text_at, odd_at, entities_col = docs.columns.index(text_col), len(names), unused(docs, entities_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts, spans = [], []
            for text, own in zip(batch.column(text_at).to_pylist(), batch.column(odd_at).to_pylist(), strict=True):
                look = held.value if own is None else {(x["kind"], x["canon"]): (x["attempt"], x["form"]) for x in own}
                new, found = rewrite(text, key, lambda k, c, look=look: look.get((k, c), (0, ""))) if text else (text, [])
                texts.append(new)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            columns = [c if i != text_at else pa.array(texts, pa.string()) for i, c in enumerate(batch.columns[:odd_at])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, spans_type)], [*names, entities_col])

    return src.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(entities_col, SPANS)]))


def with_attempts(docs: DataFrame, odd: DataFrame, text_col: str) -> DataFrame:
    """docs plus the unusual ones of its own entities (empty if none) as the last column, by shuffle joins on text hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *x) for k, t in enumerate(batch.column(1).to_pylist()) if t for x in {y[2:4]: None for y in detect(t)}]
            at, kind, canon = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(kind, pa.string()), pa.array(canon, pa.string())], [of, "kind", "canon"])

    text, of, key, looked = F.sha2(F.col(text_col).cast("binary"), 256), *(unused(docs, x) for x in ("text_of", "text_key", "looked_up"))
    own = docs.where(F.col(text_col).isNotNull()).select(text.alias("t"), F.col(text_col).alias("x")).mapInArrow(work, f"`{of}` string, kind string, canon string").distinct()
    lists = own.join(odd, ["kind", "canon"]).groupBy(of).agg(F.collect_list(F.struct("kind", "canon", "attempt", "form")).alias(looked))
    lists = materialize(lists, "pii-lists")
    joined = docs.withColumn(key, text).join(lists, F.col(key) == F.col(of), "left")
    return joined.select(*docs.columns, F.coalesce(looked, F.array().cast(LOOKUP)).alias(looked))
