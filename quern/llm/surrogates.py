"""Surrogates for personal data: keyed replacements of the same type, gender, script and format.

A value is written in symbols of small classes (digits, letters of one case and script, hexadecimal digits, names of one
gender and script); a keyed permutation of all values of that form gives its surrogate. So equal values get equal
surrogates in every document, different ones different surrogates, and no table of values is needed. What a permutation
cannot see is whether a surrogate is itself somebody's value in this corpus: the distinct values are checked against all
surrogates, and the few that clash are drawn again until none is left. Where a corpus fills a form, draws grow longer.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, fresh, spread, table, texts_of

#: Common given names by script and gender.
GIVEN = {
    "latin female": "Anna Maria Emma Olivia Sophia Laura Julia Sarah Elena Lucia Carmen Claire Camille Charlotte Emily "
    "Hannah Lena Katharina Petra Sabine Isabelle Nathalie Monique Alice Margaret Susan Linda Barbara Patricia Jennifer",
    "latin male": "James John Robert Michael William David Richard Thomas Charles Daniel Peter Paul Martin Stefan Klaus "
    "Jürgen Hans Pierre Jean Louis Nicolas François Carlos José Miguel Antonio Pedro Javier Andrew George",
    "cyrillic female": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия",
    "cyrillic male": "Иван Пётр Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Александр",
    "greek female": "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Αγγελική",
    "greek male": "Γεώργιος Δημήτριος Κωνσταντίνος Ιωάννης Νικόλαος Χρήστος",
}
#: Forms of address before a family name.
TITLES = "Mr Mrs Ms Miss Dr Herr Frau Monsieur Madame Señor Señora"
NAMES = {kind: names.split() for kind, names in GIVEN.items()}
KIND_OF = {name: kind for kind, names in NAMES.items() for name in names}

#: Classes of symbols; a symbol maps within its class only. Vowels and other letters stay apart, so words stay sayable.
CLASSES = [
    "0123456789",
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "àâäáãéèêëíìîïóòôöõúùûü", "ÀÂÄÁÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜ", "çñß", "ÇÑ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "άέήίόύώ",
]
CLASS_OF = {c: group for group in CLASSES for c in group}


@lru_cache(1 << 14)
def symbol_class(c: str) -> str | None:
    """The symbols that may stand for a letter or digit: its class above, else those of its script, category and stretch of
    256 code points whose case maps to one symbol. None for marks, spaces and what is alone."""
    if c in CLASS_OF or not (c.isalpha() or c.isdecimal()):
        return CLASS_OF.get(c)

    def kind(x: str) -> tuple:
        return unicodedata.name(x, "").split(" ")[0], unicodedata.category(x), len(x.lower()) == 1 == len(x.upper())

    first, own = ord(c) & ~0xFF, kind(c)
    alike = "".join(x for x in map(chr, range(first, first + 256)) if kind(x) == own and x not in CLASS_OF)
    return alike if len(alike) > 1 else None

_WORD, _HEX = r"[^\W\d_]", r"[0-9A-Fa-f]{1,4}"
_PATTERN = re.compile(
    rf"""
    (?P<email>[\w%+](?:[\w.%+-]*[\w%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)
  | (?P<secret>\b(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{20,}}|sk-[A-Za-z0-9_-]{{20,}}|[0-9a-f]{{32,}}|[0-9A-F]{{32,}})\b)
  | (?P<iban>\b[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?\b)
  | (?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){{3}}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.\d))
  | (?P<ip6>(?<![\w:.])(?:{_HEX}(?::{_HEX}){{7}}|{_HEX}(?::{_HEX}){{1,5}}::{_HEX}(?::{_HEX}){{0,5}}|{_HEX}::{_HEX}(?::{_HEX}){{1,5}})(?![\w:]|\.\d))
  | (?P<phone>(?<![\w+])(?:\+\d{{1,3}}[ .-]?)?\(\d{{2,4}}\)[ .-]?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,3}}(?!\w)
      |(?<![\w+])\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,5}}(?!\w)|(?<![\w-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\w-]))
  | (?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
  | (?P<card>(?<![\w-])\d(?:[ -]?\d){{12,18}}(?![\w-]))
    """,
    re.VERBOSE,
)
_MARK = re.compile(r"[@\d]|\b[0-9A-Fa-f]{32}|sk-|AKIA|gh[pousr]_|[0-9A-Fa-f]:[0-9A-Fa-f:]")
#: Words that may follow a given name with a capital and are no family name, and particles of family names.
NO_FAMILY = (
    "The This That These Those And Or But If When While As At By For From In Into Of On Onto Over To Under With Without Is Was Are "
    "Were Be Been Has Had Have Will Would Can Could Did Does Do Not He She It They We You His Her Its Their Our My Your Who What "
    "Und Oder Aber Der Die Das Ein Eine Im Am Auf Aus Bei Mit Nach Von Vor Zu Ist War Hat Er Sie Es Wir Nicht "
    "Et Ou Mais Le Les Un Une Dans En Sur Avec Pour Par Est Il Elle Ils Nous Vous Ne Y O Pero El Los Las Con Por Para Que Se Su"
).split()
PARTICLES = "de De del Del della Della di Di da Da du Du des Des la La le Le van Van von Von der Der den Den ter Ter"
_CAPITAL = rf"(?=[^\W\d_a-zа-яα-ω])(?!(?:{'|'.join(NO_FAMILY)})\b){_WORD}{{2,}}(?:-{_WORD}{{2,}})?"
_NAME = re.compile(
    rf"\b(?P<given>{'|'.join(sorted(KIND_OF, key=len, reverse=True))}) (?:{_WORD}\. )?(?:(?:{PARTICLES.replace(' ', '|')}) )*(?P<family>{_CAPITAL})"
    rf"|\b(?P<title>{'|'.join(TITLES.split())})\.? (?:(?:{PARTICLES.replace(' ', '|')}) )*(?P<called>{_CAPITAL})"
)
#: A word that the names' pattern begins with, wherever it allows one: what lacks it holds no name of that kind.
_NAME_WORDS = KIND_OF.keys() | set(TITLES.split())
#: Words after which a person is named, in lower case, and forms of address of scripts whose letters have no case.
CONTEXTS = (
    "my name is", "name:", "full name:", "signed by", "signed:", "contact person:", "attn:", "patient:", "mein name ist", "ich heiße", "name ist", "je m'appelle", "mon nom est", "nom:",
    "me llamo", "mi nombre es", "nombre:", "меня зовут", "имя:", "г-н", "г-жа", "με λένε", "όνομα:", "κύριος", "κυρία", "我叫", "我的名字是", "姓名:", "姓名：", "اسمي", "السيد", "السيدة", "मेरा नाम", "श्री", "श्रीमती",
)
#: A name by its shape: two to four words of letters that all begin with a capital, with initials and particles among them; of
#: letters without case, one or two words in Arabic, one to three in Devanagari, two to four signs in Han.
_SHAPED = rf"(?:{_CAPITAL})(?: {_WORD}\.)?(?: (?:{PARTICLES.replace(' ', '|')}))*(?: (?:{_CAPITAL})){{1,3}}"
_UNCASED = r"[\u0620-\u064A\u0671-\u06D3]{2,}(?: [\u0620-\u064A\u0671-\u06D3]{2,})?|[\u0900-\u0963]{2,}(?: [\u0900-\u0963]{2,}){0,2}|[\u4E00-\u9FFF]{2,4}"
#: A label such as "name:" calls nobody where a word stands right before it ("file name:"); Han has no spaces before its words.
_LABELS = [c for c in CONTEXTS if c[-1] in ":：" and " " not in c]
_EDGES = (("", [c for c in CONTEXTS if "\u4e00" <= c[0] <= "\u9fff"]), (r"(?<![^\W_])(?<![^\W_] )", _LABELS), (r"(?<![^\W_])", [c for c in CONTEXTS if c not in _LABELS]))
_CONTEXT = "|".join(edge + re.escape(c) for edge, group in _EDGES for c in sorted(group, key=len, reverse=True))
_CALLED = re.compile(rf"(?:{_CONTEXT})[ \t]*(?P<who>(?-i:{_UNCASED}|{_SHAPED}))", re.IGNORECASE)
#: Particles, and words that end a name of letters without case.
_SMALL = {*PARTICLES.split(), "है", "हूँ", "और", "و"}
_PARTS = re.compile(r"\w+")

Value = tuple[str, str]  # a type and the value's canonical form


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size-1: a Feistel network over the next power of four, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for turn in range(8):
            seed = f"{tweak}|{turn}|{right}".encode()
            left, right = right, left ^ int.from_bytes(hashlib.blake2b(seed, key=key).digest(), "big") & mask
        value = left << half | right
        if value < size:
            return value


def permute_symbols(text: str, key: bytes, tweak: str, classes: Callable[[str], str | None] = symbol_class) -> str:
    """Each symbol of a known class changes within it, all of them together as one number; the others stay."""
    groups = [classes(c) for c in text]
    value, size = 0, 1
    for c, group in zip(text, groups):
        if group:
            value, size = value * len(group) + group.index(c), size * len(group)
    if size == 1:
        return text
    value = permute(value, size, key, tweak + "|" + "".join(g[0] if g else c for c, g in zip(text, groups)))
    out = []
    for c, group in zip(reversed(text), reversed(groups)):
        if group:
            value, at = divmod(value, len(group))
            c = group[at]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> bool:
    twice = (int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def _ip_kind(n: int) -> str:
    a, b = n >> 24, n >> 16 & 255
    if a in (10, 127) or (a, b) == (192, 168) or a == 172 and 16 <= b < 32:
        return "private"
    return "other" if a == 0 or a >= 224 else "public"


def canonical(kind: str, text: str) -> str:
    """What two spellings of one value share."""
    if kind == "email":
        return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if kind == "ip6":
        return text.lower()
    if kind in ("phone", "card", "ssn"):
        return ("+" if text.startswith("+") else "") + re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    return text


#: From this attempt on draws get a symbol more every STEP attempts: types of free length soon, others where all else fails.
FREE, LAST, STEP = 4, 12, 4


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The surrogate of a canonical value. Per type and form a permutation, for each attempt another one.

    Attempts from FREE on (LAST for types of fixed length) permute longer forms, since the value's own may be full.
    """
    tweak = f"{kind}|{attempt}"
    from_here = FREE if kind in ("family", "email", "secret") else LAST
    more = 0 if attempt < from_here or kind.startswith("given ") else 1 + (attempt - from_here) // STEP
    if more and kind not in ("email", "secret"):
        return permute_symbols(value + value[-1] * more, key, tweak)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        local += "a" * more
        labels = domain.split(".")
        named = ".".join(permute_symbols(x, key, f"domain|{attempt}") for x in labels[:-1])
        return f"{permute_symbols(local, key, tweak)}@{named}.{labels[-1]}"
    if kind in ("card",):
        out = value
        while True:
            out = permute_symbols(out, key, tweak)
            if _luhn(out) == _luhn(value):
                return out
    if kind == "ip":
        number = int.from_bytes(bytes(map(int, value.split("."))), "big")
        out = number
        while True:
            out = permute(out, 1 << 32, key, tweak)
            if _ip_kind(out) == _ip_kind(number):
                return ".".join(map(str, out.to_bytes(4, "big")))
    if kind == "ip6":
        head, colon, rest = value.partition(":")
        return head + colon + permute_symbols(rest, key, tweak + head, lambda c: None if c == ":" else "0123456789abcdef")
    if kind == "phone" and value.startswith("+"):
        country = 1 if value[1] in "17" else 2
        return value[: 1 + country] + permute_symbols(value[1 + country :], key, tweak + value[: 1 + country])
    if kind == "iban":
        body = permute_symbols(value[4:], key, tweak + value[:2])
        ok = _iban_rest(value[4:] + value[:4]) == 1
        check = f"{98 - _iban_rest(body + value[:2] + '00'):02d}" if ok else value[2:4]
        return value[:2] + check + body
    if kind == "secret":
        value += "a" * more
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
            letters = "0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"
            return permute_symbols(value, key, tweak, lambda c: letters)
        fixed = 4 if value[:2] != "sk" else 3
        return value[:fixed] + permute_symbols(value[fixed:], key, tweak)
    if kind.startswith("given "):
        names = NAMES[kind.removeprefix("given ")]
        return names[permute(names.index(value), len(names), key, tweak)]
    return permute_symbols(value, key, tweak)


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def reshaped(kind: str, text: str, new: str) -> str:
    """A canonical surrogate in the spelling of the text that it replaces."""
    if kind == "ip6" and not any(c.islower() for c in text):
        return new.upper()
    if kind == "email" and len(text) == len(new):
        return "".join(n.upper() if t.isupper() and len(n.upper()) == 1 else n for t, n in zip(text, new))
    if kind in ("phone", "card", "ssn", "iban"):
        letters = iter(new.removeprefix("+"))
        return "".join(next(letters) if c.isalnum() else c for c in text) + "".join(letters)
    return new


def _named(text: str) -> dict[str, str]:
    """Parts of names that stand in the text in full, and their types: by listed names and forms of address, and by context and
    shape, which tell neither the gender nor which part is the family's."""
    parts: dict[str, str] = {}
    if not _NAME_WORDS.isdisjoint(_PARTS.findall(text)):
        for m in _NAME.finditer(text):
            if m["given"]:
                parts[m["given"]] = "given " + KIND_OF[m["given"]]
            parts.setdefault(m["family"] or m["called"], "family")
    low = text.lower()
    if any(c in low for c in CONTEXTS):
        for m in _CALLED.finditer(text):
            for word in m["who"].split(" "):
                if len(word) > 1 and not word.endswith(".") and word not in _SMALL:
                    parts.setdefault(word, "given " + KIND_OF[word] if word in KIND_OF else "family")
    return parts


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value) of each entity, in order and without overlap.

    A run of 13 to 19 digits is a card only if its check digit holds. Names of persons are a listed given name and a capitalised
    family name, a title and a family name, or what has the shape of a name after words that call somebody by name; once a
    text has such a name, its parts count wherever they stand alone in that text.
    """
    found = []
    if _MARK.search(text):
        for m in _PATTERN.finditer(text):
            value = canonical(m.lastgroup, m[0])
            if m.lastgroup != "card" or _luhn(value):
                found.append((m.start(), m.end(), m.lastgroup, value))
    parts = _named(text)
    if parts:
        alone = re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, sorted(parts, key=len, reverse=True)))})(?![^\W_])")
        found += [(*m.span(), parts[m[0]], m[0]) for m in alone.finditer(text)]
        for word in parts:  # signs that no space parts from others
            if "\u4e00" <= word[0] <= "\u9fff":
                found += [(m.start(), m.end(), parts[word], word) for m in re.finditer(re.escape(word), text)]
    out: list[tuple[int, int, str, str]] = []
    for x in sorted(found):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


class Replacer:
    def __init__(self, key: bytes, attempts: dict[Value, int]):
        self.attempts = attempts
        self.draw = lru_cache(100_000)(lambda kind, value, attempt: surrogate(kind, value, key, attempt))

    def __call__(self, text: str, more: dict[Value, int] | None = None) -> tuple[str, list[tuple]]:
        """The text with surrogates, and (type, start, end, surrogate) of each, placed in the text given."""
        parts, spans, last = [], [], 0
        for start, end, kind, value in detect(text):
            attempt = (more or self.attempts).get((kind, value), 0)
            new = reshaped(kind, text[start:end], self.draw(kind, value, attempt))
            parts += [text[last:start], new]
            spans.append((kind, start, end, new))
            last = end
        return "".join([*parts, text[last:]]), spans


ENTITIES = "kind string, value string, new string, attempt int"


def _entities(frames: Iterator[pd.DataFrame], key: bytes) -> Iterator[pd.DataFrame]:
    draw = lru_cache(100_000)(lambda kind, value: surrogate(kind, value, key))
    for f in frames:
        seen = {(kind, value) for text in texts_of(f["text"]) for _, _, kind, value in detect(text)}
        rows = [(kind, value, draw(kind, value), 0) for kind, value in sorted(seen)]
        yield pd.DataFrame(rows, columns=["kind", "value", "new", "attempt"])


def _again(frames: Iterator[pd.DataFrame], key: bytes) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [(k, v, surrogate(k, v, key, a + 1), a + 1) for k, v, a in zip(f["kind"], f["value"], f["attempt"])]
        yield pd.DataFrame(rows, columns=["kind", "value", "new", "attempt"])


def settled_entities(docs: DataFrame, key: bytes, rounds: int = 40) -> DataFrame:
    """kind, value, new, attempt of every distinct value of the corpus, with no clash left.

    A clash is a surrogate that is another value's surrogate or itself a value of its type. A value keeps its draw if
    it came before the others of its clash in byte order and is no value itself. Names of a closed list are exempt from
    the second rule, since the list may be used up; they stay distinct. Raises if clashes are left after all rounds.
    """
    entities = spread(docs.select(F.col("text").cast("string").alias("text"))).mapInPandas(partial(_entities, key=key), ENTITIES)
    entities = cut(entities.dropDuplicates(["kind", "value"]))
    for _ in range(rounds):
        taken = entities.where(~F.col("kind").startswith("given ")).select(
            F.col("kind").alias("k"), F.col("value").alias("n"), F.lit(True).alias("is_value")
        )
        first = entities.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("first"))
        joined = entities.join(first, ["kind", "new"]).join(
            taken, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("n")), "left"
        )
        clash = (F.col("first.value") != F.col("value")) | F.coalesce("is_value", F.lit(False))
        marked = cut(joined.select("kind", "value", "new", "attempt", clash.alias("clash")))
        if marked.where("clash").isEmpty():
            break
        kept = marked.where("not clash").select("kind", "value", "new", "attempt")
        redrawn = marked.where("clash").select("kind", "value", "new", "attempt").mapInPandas(partial(_again, key=key), ENTITIES)
        entities = cut(kept.unionByName(redrawn))
    else:
        raise RuntimeError(f"surrogates still clash after {rounds} rounds")
    return entities


RESULT = "struct<text:string,spans:array<struct<kind:string,start:int,end:int,surrogate:string>>>"
MAX_BROADCAST = 100_000


def _replacing(replacer: Callable[[], Replacer], text: Column, more: Column | None = None) -> Column:
    if more is None:

        @F.pandas_udf(RESULT)
        def replaced(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(map(replacer(), texts_of(texts)), columns=["text", "spans"])

        return replaced(text)

    @F.pandas_udf(RESULT)
    def replaced_with(texts: pd.Series, given: pd.Series) -> pd.DataFrame:
        own = ({(x["kind"], x["value"]): x["attempt"] for x in g} if g is not None else {} for g in given)
        return pd.DataFrame(map(replacer(), texts_of(texts), own), columns=["text", "spans"])

    return replaced_with(text, more)


def _mentions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = {(h, kind, value) for h, t in zip(f["h"], texts_of(f["text"])) for _, _, kind, value in detect(t)}
        yield pd.DataFrame(sorted(rows), columns=["h", "kind", "value"])


def replace_entities(docs: DataFrame, key: bytes, text: str = "text", spans: str = "_spans") -> DataFrame:
    """docs with surrogates in `text` and a new column `spans` (kind, start, end in the old text, surrogate).

    Detects e-mail addresses, telephone, card, account and social security numbers, IP addresses, access keys and
    names of persons. Letters and digits of every script change within it. key: a secret of the caller, up to 64 bytes,
    which undoes the surrogates for whoever has it. Other text, all other columns and null texts stay as they are; a text without entities has no
    spans; repeated rows get equal results. One key gives one mapping for all documents; a value that clashed is drawn
    again alike everywhere. `spans` must not be a column of docs.
    """
    spark = docs.sparkSession
    again = settled_entities(docs.select(F.col(text).alias("text")), key).where("attempt > 0").select("kind", "value", "attempt")
    body, made = F.col(text).cast("string"), fresh(docs, "_made")
    if again.count() <= MAX_BROADCAST:  # usually none
        attempts = spark.sparkContext.broadcast({(r["kind"], r["value"]): r["attempt"] for r in again.collect()})
        out = docs.withColumn(made, _replacing(lambda: Replacer(key, attempts.value), body))
    else:  # too many to send to every task: each text gets its own through a join on its hash
        texts = docs.select(F.xxhash64(body).alias("h"), body.alias("text"))
        hit = texts.mapInPandas(_mentions, "h long, kind string, value string").distinct().join(again, ["kind", "value"])
        own, h = fresh(docs, "_own"), fresh(docs, "_h")
        per_text = hit.groupBy(F.col("h").alias(h)).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(own))
        named = docs.withColumn(fresh(docs, "_text_hash"), F.xxhash64(body))
        joined = named.join(per_text, F.col(fresh(docs, "_text_hash")) == F.col(h), "left")
        out = joined.withColumn(made, _replacing(lambda: Replacer(key, {}), body, F.col(own)))
    new = F.when(F.col(text).isNotNull(), F.col(f"{made}.text")).alias(text)
    return out.select(*[new if c == text else F.col(f"`{c}`") for c in docs.columns], F.col(f"{made}.spans").alias(spans))


_DRAWN = secrets.token_bytes(32)


def surrogate_key(spark: SparkSession) -> bytes:
    """The key in spark.quern.surrogates.key; without it one drawn for this driver alone, which nobody keeps."""
    given = spark.conf.get("spark.quern.surrogates.key", "")
    return hashlib.blake2b(given.encode()).digest() if given else _DRAWN


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, surrogate_key(spark)).select("doc_id", "text", F.size("_spans").alias("n_entities"), F.col("_spans").alias("entities"))
