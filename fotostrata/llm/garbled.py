"""Finding texts decoded with the wrong encoding, and restoring them by minimum description length.

Every chain of repairs that applies to a stretch gives a candidate original. Each
is compressed with a zstandard dictionary per language; the chain with the
shortest description, its own cost included, wins, and a stretch that no chain
shortens stays as it is. A stretch in which bytes are gone for good (replacement
characters, or sequences that lost their control characters) cannot be restored
and makes the record's restored text empty.

The dictionaries are the words and pairs of neighbouring words of all the data's
own clean texts, by how many texts have them; the letters of a language are
counted over all of them too.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotostrata.operators.lookup import skewed_lookup
from fotostrata.session import materialise

#: Bytes that each step of a chain costs. Texts are measured in UTF-16, where no script is dearer than another.
UTF8_COST, TABLE_COST, ENTITY_COST = 1, 3, 1
#: Bytes for a symbol or control character inside a word, and for a letter that no language of the data uses.
ODD_COST = 3
MAX_STEPS = 3

# Encodings that UTF-8 is mistaken for, and pairs (mistaken for, really).
UTF8_READ_AS = ["cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp1253", "koi8_r", "iso8859_2", "iso8859_15"]
TABLE_PAIRS = [
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp1253"), ("cp1252", "cp1250"), ("cp1252", "iso8859_2"),
    ("cp1252", "shift_jis"), ("cp1252", "euc_jp"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("cp437", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"),
    ("cp1250", "cp1252"), ("cp437", "shift_jis"), ("mac_roman", "shift_jis"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1253", "cp1252"),
]
_WRAP = re.compile(r'^(\s*\[\s*"|\s*\{\s*"[^"]*"\s*:\s*"|lang="[^"]*"\s+|)(.*?)("\s*[\]}]\s*|)$', re.S)
_PARTS = re.compile(r"(; | \| | / )")
_WORD = re.compile(r"[^\W\d_]+")
_ENTITY = re.compile(r"&#\d{2,7};|&#x[0-9a-fA-F]{2,6};")


@lru_cache(maxsize=None)
def byte_of(encoding: str) -> dict[str, int]:
    """Byte of each character under an encoding; under cp1252 and mac_roman the bare C1 controls count as their bytes too."""
    table: dict[str, int] = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    if encoding in ("cp1252", "cp1250", "cp1253", "cp1251"):
        for b in range(128, 160):
            table.setdefault(chr(b), b)
    return table


def repair_utf8(text: str, encoding: str) -> tuple[str, int, int]:
    """UTF-8 sequences that were read one byte at a time, put together again.

    Returns the text, how many sequences were repaired, and how many other
    characters are left that stand for a byte of 128 or more.
    """
    table = byte_of(encoding)
    out, repaired, bare, i = [], 0, 0, 0
    while i < len(text):
        lead = table.get(text[i])
        if lead is None:
            out.append(text[i])
            i += 1
            continue
        size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        raw = [table.get(c, -1) for c in text[i : i + size]] if size else []
        if size and len(raw) == size and all(0x80 <= b <= 0xBF for b in raw[1:]):
            try:
                out.append(bytes(raw).decode("utf-8"))
                repaired += 1
                i += size
                continue
            except UnicodeDecodeError:
                pass
        out.append(text[i])
        bare += 1
        i += 1
    # where most such characters stand alone, the few that fit together do so by chance
    return ("".join(out), repaired, bare) if repaired >= bare else (text, 0, bare)


def lost_leads(text: str) -> bool:
    """Whether UTF-8 sequences read as cp1252 stand beside leads whose other bytes, control characters, are gone."""
    table, whole, i, alone = byte_of("cp1252"), 0, 0, 0
    while i < len(text):
        b = table.get(text[i], 0)
        size = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        tail = 0
        while size and tail < size - 1 and i + tail + 1 < len(text) and 0x80 <= table.get(text[i + tail + 1], 0) <= 0xBF:
            tail += 1
        if b and not size:
            return False  # neither a lead nor part of a sequence
        whole += bool(size) and tail == size - 1
        alone += bool(size) and tail < size - 1
        i += 1 + tail
    return bool(whole and alone) or bool(alone and re.search("[ÃÂÐÑÅÄ]{2}[a-z]", text))


def swap_tables(text: str, read_as: str, really: str) -> str | None:
    """The whole stretch encoded as it was read and decoded as it should have been; null if that is impossible."""
    table = byte_of(read_as)
    raw = bytearray()
    for c in text:
        b = ord(c) if ord(c) < 128 else table.get(c)
        if b is None:
            return None
        raw.append(b)
    try:
        got = bytes(raw).decode(really)
    except UnicodeDecodeError:
        return None
    return None if any(unicodedata.category(c) in ("Cc", "Co", "Cn") and c not in "\t\r\n" for c in got) else got


def language_of(text: str) -> str:
    """A rough class for the dictionaries, by script and letters."""
    for name, letters in (
        ("ja", r"[぀-ヿ一-鿿]"), ("ru", r"[Ѐ-ӿ]"), ("el", r"[Ͱ-Ͽ]"), ("pl", "[ąćęłńśźżĄĆĘŁŃŚŹŻ]"),
    ):
        if re.search(letters, text):
            return name
    votes = {
        "pt": len(re.findall(r"[ãõ]|ção|\b(?:de|em|com|na|às|perto|uma?|não)\b", text)),
        "es": len(re.findall(r"[ñ¿¡]|\b(?:el|los|cerca|después|en|con|del|de)\b", text)),
        "de": len(re.findall(r"[ßÄÖÜ]|\b(?:der|die|das|und|bei|für|über|den)\b", text)),
        "fr": len(re.findall(r"[’œ]|\b(?:près|du|été|la|le|les|été|neige)\b|[èêë]e", text)),
        "en": len(re.findall(r"\b(?:the|of|and|was|from|is|at)\b", text)),
    }
    best = max(votes, key=lambda k: votes[k])
    return best if votes[best] else "en"


def odd_symbols(text: str) -> int:
    """Symbols and control characters that touch a letter."""
    count = 0
    for i, c in enumerate(text):
        if ord(c) > 127 and unicodedata.category(c) in ("So", "Sm", "Sc", "Sk", "No", "Cc", "Co", "Cn"):
            count += (i > 0 and text[i - 1].isalpha()) or (i + 1 < len(text) and text[i + 1].isalpha())
    return count


def suspicious(text: str) -> bool:
    """Whether a text is no fit example of its language: some chain may apply to it."""
    if "�" in text or _ENTITY.search(text):
        return True
    return not text.isascii() and (
        any(repair_utf8(text, e)[1] for e in UTF8_READ_AS)
        or bool(re.search("[\u0080-\u009f⁰-₟─-▟√∂∫≈≤≥ÃÂÐÑÅ]|[À-ÿ]{3,}|[a-z][Α-ωЀ-ӿ]|[Α-ωЀ-ӿ][a-z]", text))
        or odd_symbols(text) > 0
    )


class Restorer:
    """Restores stretches with the dictionaries ``texts``: language to clean texts or phrases, the most frequent last.

    ``letters`` of each language are those that more than one of its texts has;
    without them they are counted in ``texts``.
    """

    def __init__(self, texts: dict[str, list[str]], letters: dict[str, set[str]] | None = None):
        self.coders, self.alphabets = [], []
        for lang in sorted(texts):
            raw = "\n".join(texts[lang]).encode("utf-16-le", "replace")
            if len(raw) >= 16:
                book = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.coders.append(zstandard.ZstdCompressor(level=12, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False))
                if letters is None:
                    seen = Counter(c for t in texts[lang] for c in set(t) if ord(c) > 127 and c.isalpha())
                    self.alphabets.append({c for c, n in seen.items() if n > 1})
                else:
                    self.alphabets.append(letters.get(lang, set()))
        if not self.coders:
            self.coders.append(zstandard.ZstdCompressor(level=12, write_content_size=False, write_checksum=False))
        self.known = set().union(*self.alphabets) if self.alphabets else None
        self.cost = lru_cache(maxsize=100_000)(self._cost)

    def _cost(self, text: str) -> float:
        raw = text.encode("utf-16-le", "replace")
        strange = 0 if self.known is None else sum(ord(c) > 127 and c.isalpha() and c not in self.known and c.lower() not in self.known for c in text)
        return min(len(c.compress(raw)) for c in self.coders) + ODD_COST * (odd_symbols(text) + strange)

    def one_language(self, text: str) -> bool:
        """Whether the letters of a text are all in use in one language."""
        letters = {c for c in text if ord(c) > 127 and c.isalpha()}
        letters = {c if c.lower() == c or c in self.known else c.lower() for c in letters} if self.alphabets else letters
        return not self.alphabets or any(letters <= a for a in self.alphabets)

    def candidates(self, part: str) -> dict[str, tuple[int, int, bool]]:
        """Text of every chain that applies: (cost of the chain, bare bytes left after its last UTF-8 step, whether UTF-8 sequences prove it)."""
        found: dict[str, tuple[int, int, bool]] = {}
        todo = [(part, 0, 0, False)]
        while todo:
            text, cost, steps, proven = todo.pop()
            if steps == MAX_STEPS:
                continue
            grown = []
            if steps == 0 and _ENTITY.search(text):
                grown.append((html.unescape(text), ENTITY_COST, 0, False))
            for e in UTF8_READ_AS:
                got, repaired, bare = repair_utf8(text, e)
                if repaired:
                    grown.append((got, UTF8_COST, bare, True))
            # a table swap leaves no sequence behind to prove it: it is tried only on letters no language uses together
            if steps == 0 and (odd_symbols(text) or not self.one_language(text)):
                letters = sum(map(str.isalpha, text))
                for a, b in TABLE_PAIRS:
                    got = swap_tables(text, a, b)
                    if got is None or got == text or not self.one_language(got):
                        continue
                    # symbols may turn into letters, and two into one of another script, but letters never into symbols
                    if odd_symbols(got) == 0 and (sum(map(str.isalpha, got)) >= letters or re.search("[぀-ヿ一-鿿]", got)):
                        grown.append((got, TABLE_COST, 0, False))
            for got, more, bare, proves in grown:
                if got != part and (got not in found or found[got][0] > cost + more):
                    found[got] = (cost + more, bare, proven or proves)
                    todo.append((got, cost + more, steps + 1, proven or proves))
        return found

    def stretch(self, part: str) -> str | None:
        """The original of a stretch, "" if bytes of it are gone, None if it is not garbled."""
        if "�" in part:
            return ""
        if part.isascii() and not _ENTITY.search(part):
            return None
        found = self.candidates(part)
        lost = lost_leads(part)
        best, least, bare = None, self.cost(part) if found else 0, 0
        for text, (extra, left, proven) in sorted(found.items()):
            if lost and (left or not proven):
                continue  # with bytes gone, only a chain that accounts for all of them is believed
            total = self.cost(text) + extra
            if total < least:
                best, least, bare = text, total, left
        if best is None:
            return "" if lost else None
        return "" if bare else best

    def restore(self, value: str) -> str | None:
        """The whole field restored, "" if bytes of it are gone, None if nothing in it is garbled."""
        before, inner, after = _WRAP.match(value).groups()
        parts = _PARTS.split(inner)
        done = [self.stretch(p) if i % 2 == 0 else None for i, p in enumerate(parts)]
        if all(d is None for d in done):
            return None
        if any(d == "" for d in done):
            return ""
        return before + "".join(p if d is None else d for p, d in zip(parts, done, strict=True)) + after


def phrases_of(text: str) -> set[str]:
    """The words of a text, and every two of them that follow each other with what stands between."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return {text[i:j] for i, j in spans} | {text[i:j] for (i, _), (_, j) in pairwise(spans)}


def language_models(values: DataFrame) -> tuple[dict[str, list[str]], dict[str, set[str]]]:
    """(phrases, letters) of each language, counted over all distinct clean texts among ``values`` (value), of any length.

    Phrases come in order of how many texts have them, the most frequent last,
    where a dictionary is cheapest to refer to; letters are those beyond ASCII
    that more than one text has. Only the counts reach the driver: they grow
    with the vocabulary, not with the rows.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], []]
            for value in batch.column(0).to_pylist():
                inner = _WRAP.match(value).group(2)
                if re.search(r"[^\W\d_]{3}", inner) and not suspicious(inner):
                    out[0].append(language_of(inner))
                    out[1].append(inner)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], names=["lang", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.update((lang, False, p) for p in phrases_of(text))
                seen.update((lang, True, c) for c in set(text) if ord(c) > 127 and c.isalpha())
            columns = list(zip(*[(*key, n) for key, n in seen.items()], strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.bool_(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["lang", "letter", "item", "n"])

    distinct = values.where(F.length("value") >= 3).select("value").distinct()
    texts = distinct.mapInArrow(clean, "lang string, text string").distinct()
    counts = texts.mapInArrow(count, "lang string, letter boolean, item string, n long").groupBy("lang", "letter", "item").agg(F.sum("n").alias("n"))
    phrases: dict[str, list[str]] = {}
    letters: dict[str, set[str]] = {}
    for lang, letter, item, n in sorted(map(tuple, counts.where("n > 1 or not letter").collect()), key=lambda r: (r[3], r[2])):
        if letter:
            letters.setdefault(lang, set()).add(item)
        else:
            phrases.setdefault(lang, []).append(item)
    return phrases, letters


def restore_garbled(values: DataFrame) -> DataFrame:
    """(source_table, record_id, restored) of every garbled value.

    ``values`` has source_table, record_id and value. restored is the whole value
    with garbled stretches replaced, or empty where bytes are gone for good. Null
    and empty values, plain ASCII without character references, and values no
    repair shortens are not garbled. Each distinct value is examined once, at its
    whole length; repeated rows come out repeatedly. An empty table gives no rows.
    """
    spark = values.sparkSession
    given = values.select("source_table", "record_id", "value").where(F.col("value").isNotNull() & (F.col("value") != ""))
    shared = spark.sparkContext.broadcast(language_models(given))
    odd = given.where(F.col("value").rlike(r"[^\x00-\x7f]|&#"))
    distinct = odd.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = None
        for batch in batches:
            restorer = restorer or Restorer(*shared.value)
            got = [restorer.restore(v) for v in batch.column(0).to_pylist()]
            keep = pa.array([i for i, g in enumerate(got) if g is not None], pa.int64())
            found = pa.array([g for g in got if g is not None], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), found], names=["value", "n_rows", "restored"])

    # few bytes but much work a row: spread over all cores, which adaptive execution would undo for a partitioning by key
    spread = distinct.repartition(max(8, spark.sparkContext.defaultParallelism * 2))
    restored = materialise(spread.mapInArrow(run, "value string, n_rows long, restored string"), "restored")
    return skewed_lookup(odd, restored, ["value"], "n_rows").select("source_table", "record_id", "restored")
