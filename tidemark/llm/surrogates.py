"""PII surrogates: detected entities get keyed replacements of the same type, format, script and gender.

A replacement is drawn from a keyed hash of the entity's type and normal form, so the same entity gets
the same replacement in every document, however it is written (coreference).  Distinctness is checked
over the whole corpus: where two entities drew the same replacement, or one drew what really occurs,
all but one draw again until none clash.  Only the entities that had to draw again are looked up when
the texts are rewritten; all others are drawn on the spot.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, stored, text_session
from tidemark.session import cut_lineage

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_SECRETS = (
    re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)\W{0,6}[=:]\W{0,6}?[\"']?([^\s\"'|]{8,})"),
    re.compile(r"(?<![0-9A-Za-z])((?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,})(?![0-9A-Za-z])"),
    re.compile(r"(?<![0-9A-Za-z])((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z_\-]{20,}|xox[abp]-[0-9A-Za-z\-]{10,})"),
)
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
_CARD = re.compile(r"(?<![0-9A-Za-z+.\-])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z\-]|\.[0-9])")
_PHONE = re.compile(
    r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:(?! (?:[0-9]{1,3}\.){3}[0-9])[ .\-]?[0-9]{2,4}){1,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9A-Za-z])")
_IP = re.compile(r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])")
# Titles that show a person, by gender.
_TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Madame": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Srta": "f", "Doña": "f", "Госпожа": "f",
}
_PERSON = re.compile(r"(?<!\w)(" + "|".join(sorted(_TITLES, key=len, reverse=True)) + r")\.?[  ]((?:[^\W\d_]\.[ ])?[^\W\d_]['’\-\w]+(?: [^\W\d_a-z]['’\-\w]+)?)")
# Replacement given names by script and gender.
_GIVEN = {
    ("latin", "m"): "Adam Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Pablo Robin Simon Tomas Victor".split(),
    ("latin", "f"): "Alma Bianca Clara Diana Elena Flora Greta Helena Irene Julia Karla Laura Maria Nora Olivia Paula Rosa Sara Teresa Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Олег Павел Роман Сергей Тимур Юрий".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Раиса Юлия".split(),
    ("greek", "m"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Κατερίνα Μαρία Σοφία".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de di fa fe ga go ha hi ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vi wa zo".split(),
    "cyrillic": "ба бе во га го да де за ка ко ла ле ма ми на не по ра ре са се та те то ва ви".split(),
    "greek": "βα γα δα δη κα κο λα λο μα μη να νο πα ρα ρο σα σι τα το φα".split(),
}
_ENDINGS = {("latin", "m"): "r", ("latin", "f"): "r", ("cyrillic", "m"): "нов", ("cyrillic", "f"): "нова", ("greek", "m"): "ς", ("greek", "f"): "ου"}


@dataclass(frozen=True)
class Entity:
    kind: str
    normal: str
    begin: int
    end: int


def _luhn(digits: str) -> int:
    total = 0
    for place, d in enumerate(reversed(digits)):
        x = int(d) * (2 if place % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _script(word: str) -> str:
    first = ord(word[0])
    return "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 else "latin"


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Mail addresses, each read to both sides of its @: no run of letters is looked at twice."""
    before = 0
    for m in _DOMAIN.finditer(text):
        begin = m.start()
        while begin > before and text[begin - 1] in _LOCAL:
            begin -= 1
        while begin < m.start() and not text[begin].isalnum():
            begin += 1
        if begin < m.start():
            yield begin, m.end()
            before = m.end()


def detect(text: str) -> list[Entity]:
    """Entities in order; where patterns overlap, the earlier kind in this function's order wins."""
    found: list[Entity] = []
    taken = bytearray(len(text))

    def add(kind: str, normal: str, begin: int, end: int) -> None:
        if taken.find(1, begin, end) < 0:
            taken[begin:end] = b"\1" * (end - begin)
            found.append(Entity(kind, normal, begin, end))

    if "@" in text:
        for begin, end in _addresses(text):
            add("email", text[begin:end].lower(), begin, end)
    if re.search("[0-9]", text):
        for pattern in _SECRETS:
            for m in pattern.finditer(text):
                if re.search("[0-9]", m[1]):
                    add("secret", m[1].lower() if re.fullmatch("[0-9A-F]+|[0-9a-f]+", m[1]) else m[1], *m.span(1))
        for m in _IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and _iban_rest(plain) == 1:
                add("iban", plain, *m.span())
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if len(digits) == 16 or _luhn(digits) == 0:
                add("card", digits, *m.span())
        for m in _PHONE.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 9 <= len(digits) <= 15:
                add("phone", digits, *m.span())
        for m in _IP.finditer(text):
            add("ip", m[0], *m.span())
        for m in _SSN.finditer(text):
            add("ssn", m[0].replace("-", ""), *m.span())
    for m in _PERSON.finditer(text):
        gender, at = _TITLES[m[1]], m.start(2)
        words = m[2].split(" ")
        for k, word in enumerate(words):
            if not word.endswith("."):
                role = "family" if k == len(words) - 1 else "given"
                add(f"{role}-{gender}", word.lower(), at, at + len(word))
            at += len(word) + 1
    return sorted(found, key=lambda e: e.begin)


class _Draw:
    """Endless keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, normal: str, attempt: int):
        self.seed = hashlib.blake2b(f"{kind}\0{normal}\0{attempt}".encode(), key=key, digest_size=32).digest()
        self.block, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.blake2b(self.seed + self.block.to_bytes(8, "big"), digest_size=64).digest()
            self.block += 1
        number, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return number % n


def draw(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """Normal form of an entity's replacement."""
    d = _Draw(key, kind, normal, attempt)

    def like(text: str, fixed: str = "") -> str:
        out = []
        for c in text:
            if c in fixed:
                out.append(c)
            elif c.isdigit():
                out.append("0123456789"[d.below(10)])
            elif "a" <= c <= "z":
                out.append("abcdefghijklmnopqrstuvwxyz"[d.below(26)])
            elif "A" <= c <= "Z":
                out.append("ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d.below(26)])
            else:
                out.append(c)
        return "".join(out)

    if kind == "email":
        local, domain = normal.split("@", 1)
        # Names below example.* belong to nobody.
        stem = like("".join("a" if c.isalpha() else c for c in local[:1])) + like(local[1:])
        word = "".join(_SYLLABLES["latin"][d.below(len(_SYLLABLES["latin"]))] for _ in range(4))
        end = domain.rsplit(".", 1)[1]
        return f"{stem}{d.below(10000):04d}@{word}.example.{end if end in ('com', 'net', 'org') else 'org'}"
    if kind == "secret":
        # Of a secret of few letters and digits (masked ones) there are few others: later draws are longer.
        short = sum(c.isascii() and c.isalnum() for c in normal) < 16
        more = "".join("0123456789"[d.below(10)] for _ in range(attempt if short else 0))
        if re.fullmatch("[0-9a-f]+", normal):
            return "".join("0123456789abcdef"[d.below(16)] for _ in normal) + more
        head = re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-)?", normal)[0]
        return head + like(normal[len(head):]) + more
    if kind == "iban":
        body = like(normal[4:])
        return next(f"{normal[:2]}{check:02d}{body}" for check in range(2, 99) if _iban_rest(f"{normal[:2]}{check:02d}{body}") == 1)
    if kind == "card":
        body = normal[0] + like(normal[1:-1])
        right = next(str(c) for c in range(10) if _luhn(body + str(c)) == 0)
        return body + (right if _luhn(normal) == 0 else str((int(right) + 1 + d.below(9)) % 10))
    if kind == "phone":
        keep = 1 if len(normal) == 11 else 2 if len(normal) > 11 else 0  # the country code
        return normal[:keep] + str(2 + d.below(8)) + like(normal[keep + 1:])
    if kind == "ip":
        # Addresses reserved for future use: 2**28 that belong to nobody.
        return f"{240 + d.below(16)}.{d.below(256)}.{d.below(256)}.{1 + d.below(254)}"
    if kind == "ssn":
        return "9" + like(normal[1:])
    role, gender = kind.split("-")
    script = _script(normal)
    if role == "given":
        names = _GIVEN[script, gender]
        return "-".join(names[d.below(len(names))].lower() for _ in range(1 + attempt))
    syllables = _SYLLABLES[script]
    return "".join(syllables[d.below(len(syllables))] for _ in range(3 + attempt)) + _ENDINGS[script, gender]


def written_like(normal: str, kind: str, original: str) -> str:
    """A replacement's normal form in the original's writing: separators and case."""
    if kind in ("card", "phone", "iban", "ssn"):
        parts = iter(normal)
        return "".join(next(parts) if c.isalnum() else c for c in original)
    if kind == "ip":
        return normal
    letters = [c for c in original if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return normal.upper()
    if kind.startswith(("given", "family")) and original[:1].isupper():
        return "-".join(p[:1].upper() + p[1:] for p in normal.split("-"))
    return normal


def rewrite(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[dict]]:
    out, at, listed, size = [], 0, [], 0
    for e in detect(text):
        original = text[e.begin:e.end]
        new = written_like(draw(key, e.kind, e.normal, attempts.get((e.kind, e.normal), 0)), e.kind, original)
        out += [text[at:e.begin], new]
        begin = size + e.begin - at
        listed.append({"kind": e.kind, "begin": begin, "end": begin + len(new)})
        size, at = begin + len(new), e.end
    out.append(text[at:])
    return "".join(out), listed


def _found(rows: DataFrame) -> DataFrame:
    """(row_a, row_b, kind, normal) of every different entity of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(a, b, kind, normal) for a, b, text in zip(*(batch.column(k).to_pylist() for k in range(3)))
                   for kind, normal in dict.fromkeys((e.kind, e.normal) for e in detect(text))]
            columns = list(zip(*out)) if out else [[], [], [], []]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["row_a", "row_b", "kind", "normal"])

    return rows.select("row_a", "row_b", "text").mapInArrow(run, "row_a long, row_b long, kind string, normal string")


def _drawn(entities: DataFrame, key: bytes, chooser: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [chooser(key, *row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], names=["kind", "normal", "attempt", "drawn"])

    return entities.select("kind", "normal", "attempt").mapInArrow(run, "kind string, normal string, attempt int, drawn string")


def settled_attempts(entities: DataFrame, key: bytes, rounds: int = 200, chooser: Callable = draw) -> DataFrame:
    """(kind, normal, attempt) for entities whose replacement is their own only from a later draw on."""
    drawn = stored(_drawn(entities.withColumn("attempt", F.lit(0)), key, chooser), "drawn")
    # The entities do not change; read them from here, not from the texts again.
    real = drawn.select("kind", F.col("normal").alias("drawn"))
    for _ in range(rounds):
        # A replacement that another entity has too stays with the first of them; one that occurs in the texts itself goes.
        # Stored, so that Spark knows how few they are: very many entities may share one.
        twice = stored(drawn.groupBy("kind", "drawn").agg(F.min("normal").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
        late = drawn.join(twice, ["kind", "drawn"]).where("normal > first").select("kind", "normal")
        taken = drawn.join(real, ["kind", "drawn"], "left_semi").select("kind", "normal")
        again = cut_lineage(late.unionByName(taken).distinct())
        if again.isEmpty():
            return drawn.where("attempt > 0").select("kind", "normal", "attempt")
        marked = again.withColumn("more", F.lit(1))
        now = drawn.join(marked, ["kind", "normal"], "left").select(
            "kind", "normal", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))
        drawn = stored(_drawn(now, key, chooser), "drawn")
    raise RuntimeError(f"replacements still clash after {rounds} draws")


def replace_entities(docs: DataFrame, key: bytes = b"tidemark", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``text``, ``entities``) of every row: the rewritten text and where its replacements stand (kind, begin, end).

    Null and empty texts give the empty string; repeated rows are rewritten alike; a row without entities
    keeps its text; an empty table gives an empty result; other columns are not looked at.
    """
    text_session(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *row_key(id_col, text_col))
    seen = stored(_found(rows), "occurrences")
    late = settled_attempts(seen.select("kind", "normal").distinct(), key)
    exceptions = seen.join(late, ["kind", "normal"]).groupBy("row_a", "row_b").agg(
        F.collect_set(F.struct("kind", "normal", "attempt")).alias("late"))
    # Stored, so that Spark knows how few they are when it picks the join; the texts need not move then.
    joined = rows.join(stored(exceptions, "exceptions"), ["row_a", "row_b"], "left").select("id", "text", "late")
    kind = rows.schema["id"].dataType.simpleString()
    places = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = [], []
            for text, late in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                new, listed = rewrite(text, key, {(x["kind"], x["normal"]): x["attempt"] for x in late or ()})
                texts.append(new)
                lists.append(listed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lists, places)], names=["id", "text", "entities"])

    schema = f"id {kind}, text string, entities array<struct<kind: string, begin: int, end: int>>"
    return joined.mapInArrow(run, schema).withColumnsRenamed({"id": id_col})
