"""Text quality statistics per document, and what is no natural prose.

Every document gets a vector of statistics. For each language the mean and
covariance of prose are estimated robustly from all documents: a start from
medians and absolute deviations, then concentration steps that re-estimate from
the documents within a quantile of the distance. The Mahalanobis distance tells
how far a document lies from prose, and each statistic's contribution to the
squared distance tells why. A document is an outlier where the squared distance
is beyond the chi-square quantile of as many degrees of freedom as there are
statistics; its kind is the one whose statistics contribute most.

Scale: statistics are computed where the text lies and written once; the
estimation moves only sums of moments, one row per partition and language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotostrata.session import materialise

# Frequent function words of the corpus's languages.
COMMON_WORDS = {
    "en": "the of and a to in is was that it for on as with by at not are but from or an they which you there we been has what when who no so out up than them then only my me had were this because although near",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à foi é minha meu nosso embora quando perto também depois antes daquele duas nas",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le o este mi nuestro aunque cuando cerca también después antes aquel fue qué",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an war wie bei nach aus am vor unser meine obwohl bevor dieser jedes einem einer kam",
}
_LANGUAGES = sorted(COMMON_WORDS)
#: The languages of each common word, by number.
_COMMON: dict[str, list[int]] = {}
for _i, _lang in enumerate(_LANGUAGES):
    for _word in sorted(set(COMMON_WORDS[_lang].split())):
        _COMMON.setdefault(_word, []).append(_i)

_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_MARK = re.compile(r"^\s*(?:(?:\d{1,4}|[a-zA-Z]{1,2})[.)]|[-–—•*·▪◦‣+]|\[[ xX✓]?\]|[☐☑✓✗])\s+\S")
_ENDS = re.compile(r"""[.!?…:]["'”’»)\]]*\s*$""")
_SENTENCE = re.compile(r"""[.!?…]+["'”’»)\]]*(?=\s|$)""")
_TAG = re.compile(r"<(/?)([a-zA-Z]+)[^<>]*>")
_HEX = re.compile(r"^[0-9a-fA-F]{2,8}$")
_PATH = re.compile(r"^[^\s]*[/\\].*\.[A-Za-z0-9]{2,4}$")
_FILE = re.compile(r"^[\w\-~ ()]*\.[A-Za-z0-9]{2,4}$")
_ODD = re.compile(
    r"[^\W\d_][^\w\s'’.\-–—/…()“”\"»«:,;!?&@#]+[^\W\d_]|[^\W\d_][.,;:!?|~]+[^\W\d_].*[^\W\d_]?|[^\W_]\d[^\W\d_]|�|^[^\w\s]{2,}$"
)
_PLAIN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*[.,;:!?…]?")
_CASES = re.compile(r"[a-z][A-Z].*[a-z0-9][A-Z]")
_CASE = re.compile("[a-z][A-Z]")
_STOP = re.compile(r"[.!?…]\s*$")
_VOWELS = frozenset("aeiouyáàâãäéèêëíìîïóòôõöúùûü")
_PUNCTUATION = frozenset(".,;:!?'\"()-–—“”‘’„«»…¿¡")
_NUMBER = re.compile(r"^[\d.,:;/\-+%]+$")
_PART = re.compile(r"[,;|•·.!?…]\s")
_EDGE = ".,;:!?…\"'()“”‘’„«»[]"
_NAMED = re.compile(r"[^\W\d_]{3}")  # an item names something; a row of numbers does not
_WIDE = re.compile(r"\s{2,}")
_BARS = frozenset(("|", "<", ">", "©", "»", "«"))

#: The statistics, in order. The first ones describe, all but the word count take part in the distance.
STATS = [
    "n_words", "mean_word_length", "symbol_ratio", "line_end_ratio", "common_ratio", "foreign_ratio", "digit_ratio", "letter_ratio", "vowel_ratio",
    "top_word_ratio", "distinct_ratio", "words_per_sentence", "words_per_part", "parts_per_sentence", "mark_lines", "item_lines", "table_lines", "odd_tokens", "long_tokens", "number_tokens", "hash_tokens",
    "latin_ratio", "case_breaks", "bar_tokens",
]
#: The language of texts with a smaller share of common words than this.
ANY, LEAST_COMMON = "any", 0.12
CONCENTRATION_STEPS = 3
#: Documents within this quantile of the distances estimate the next mean and covariance.
KEEP_QUANTILE = 0.75
#: An estimate from n documents of a language counts n / (n + this), that over all languages the rest.
SHRINK = 100.0
#: Documents beyond this quantile of the chi-square distribution are outliers.
OUTLIER_QUANTILE = 0.99
#: Tokens over which different ones are counted, so that long texts are not poorer in words than short ones.
WINDOW = 40
#: Where neither list nor table reaches this quantile of one degree of freedom, nothing shows an order: junk.
EXPLAINED_QUANTILE = 0.999
#: The statistics that speak for a kind, with the direction in which they do; the others speak against prose alone.
SIGNATURES = {
    "table": {"table_lines": 1},
    "list": {"mark_lines": 1, "item_lines": 1, "hash_tokens": 1, "parts_per_sentence": 1},
    "junk": {"top_word_ratio": 1, "foreign_ratio": 1, "odd_tokens": 1, "long_tokens": 1, "case_breaks": 1, "number_tokens": 1, "latin_ratio": -1, "bar_tokens": 1, "words_per_part": 1, "symbol_ratio": 1},
}
#: Shares that matter only where they make up the text in the main; they are measured by their cubes.
_IN_THE_MAIN = ("mark_lines", "item_lines", "table_lines", "long_tokens", "number_tokens", "hash_tokens", "top_word_ratio", "case_breaks")
#: What rows of a table show too: it counts only for the rest of the text.
_IN_TABLES = ("mark_lines", "item_lines", "parts_per_sentence", "odd_tokens", "long_tokens", "number_tokens", "bar_tokens")
_LETTER, _LATIN, _VOWEL, _DIGIT, _SYMBOL, _BLANK = (1 << i for i in range(6))


def chi_square_quantile(q: float, d: int) -> float:
    """The quantile of the chi-square distribution with d degrees of freedom, by Wilson and Hilferty."""
    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(q) * math.sqrt(2 / (9 * d))) ** 3


def _class_of(c: str) -> int:
    if c.isspace():
        return _BLANK
    if c.isalpha():
        return _LETTER | (_LATIN if ord(c) < 0x250 else 0) | (_VOWEL if c.lower() in _VOWELS else 0)
    if c.isdigit():
        return _DIGIT
    return 0 if c.isalnum() or c in _PUNCTUATION else _SYMBOL


#: Classes of the characters of most texts; others are looked up one by one.
_CLASSES = np.array([_class_of(chr(c)) for c in range(0x2100)], np.uint8)
_BITS = np.array([[i >> bit & 1 for i in range(64)] for bit in range(6)])
_LATIN_BITS = _BITS[:, _CLASSES[:256]]


def character_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """(letters, Latin letters, vowels, digits, symbols, characters that are no blanks)."""
    try:  # most texts of one byte a character
        raw = np.frombuffer(text.encode("latin-1"), np.uint8)
        *sums, blanks = (_LATIN_BITS @ np.bincount(raw, minlength=256)).tolist()
        return *sums, len(raw) - blanks
    except UnicodeEncodeError:
        pass
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    near = codes < len(_CLASSES)
    all_near = bool(near.all())
    counts = np.bincount(_CLASSES[codes if all_near else codes[near]], minlength=64)
    if not all_near:
        far, times = np.unique(codes[~near], return_counts=True)
        for code, k in zip(far.tolist(), times.tolist(), strict=True):
            counts[_class_of(chr(code))] += k
    *sums, blanks = (_BITS @ counts).tolist()
    return *sums, len(codes) - blanks


def _unwrap(lines: list[str]) -> list[str]:
    """Lines broken at a fixed width put together again; others as they are."""
    if len(lines) < 2:
        return lines
    width = max(map(len, lines))
    if not 40 <= width <= 120:
        return lines
    breaks = full = 0
    for a, b in zip(lines, lines[1:], strict=False):
        if not a.strip() or not b.strip():
            continue
        breaks += 1
        full += len(a.rstrip()) + 1 + len(b.split()[0]) > width - 2 and "  " not in a.strip() and not _MARK.match(b)
    ends = sum(bool(_SENTENCE.search(x)) for x in lines)
    if not breaks or full < 0.7 * breaks or ends < 0.15 * len(lines):
        return lines
    out, current = [], ""
    for line in lines:
        if not line.strip():
            out.append(current)
            current = ""
        else:
            current = f"{current} {line.strip()}" if current else line.strip()
    return [x for x in [*out, current] if x.strip()]


def _table_share(lines: list[str], text: str) -> float:
    """Share of lines that are rows of the same columns, in any layout."""
    cells = inside = 0
    opened = None
    for tag in _TAG.finditer(text) if "<" in text else ():
        inside += tag.end() - tag.start()
        if tag.group(2).lower() in ("td", "th"):
            if opened is not None:
                inside += tag.start() - opened
            opened = None if tag.group(1) else tag.end()
            cells += not tag.group(1)
    best = min(1.0, inside / max(1, len(text))) if cells >= 2 else 0.0
    if len(lines) < 2:
        return best
    grid = sum(bool(re.match(r"^\s*(\+[-=+]{3,}|\|.*\|\s*$)", x)) for x in lines)
    best = max(best, grid / len(lines))
    for mark in ("\t", ";", "|", ","):
        if mark not in text:
            continue
        counts = Counter(x.count(mark) for x in lines)
        number, hits = max(((n, h) for n, h in counts.items() if n), key=lambda p: (p[1], p[0]), default=(0, 0))
        rows = [x for x in lines if number and x.count(mark) == number]
        if hits < 2 or mark == "," and any(", " in x for x in rows) and sum(", " in x for x in rows) > 0.3 * hits:
            continue
        words = sum(len(x.split()) for x in rows) / (hits * (number + 1))
        stops = sum(bool(_STOP.search(x)) for x in rows)
        if words <= 3.5 and stops <= 0.3 * hits and (number > 1 or mark == "\t" or mark == "|" or hits >= 3):
            best = max(best, hits / len(lines))
    columns = Counter(len(_WIDE.split(y)) if "  " in (y := x.strip()) or "\t" in y else 1 for x in lines)
    wide = sum(h for n, h in columns.items() if n >= 2)
    if wide >= 2:
        # columns of fixed width: most starts of cells stand below one another
        starts = Counter(m.start() for x in lines for m in re.finditer(r"(?<=\s\s)\S", x))
        aligned = sum(h for h in starts.values() if h >= max(2, 0.5 * wide))
        if aligned >= 0.5 * sum(starts.values()):
            best = max(best, wide / len(lines))
    return best


def describe(text: str) -> tuple[str, list[int], list[float]]:
    """(language, [lines, sentences, parts], statistics) of one text; the language is the one whose common words are most frequent."""
    split = text.splitlines()
    raw_lines = [x for x in split if x.strip()]
    table = _table_share(raw_lines, text)
    lines = raw_lines if table > 0.5 else [x for x in _unwrap(split) if x.strip()]
    tokens = text.lower().split()
    # each distinct token is looked at once, and most are plain words, which are nothing else
    counts: dict[str, int] = {}
    odd = longest = numbers = hashes = breaks = bars = 0
    for t, k in Counter(tokens).items():
        if t.isalpha():
            counts[t] = counts.get(t, 0) + k
            longest += k * (len(t) > 30)
            continue
        bare = t.strip(_EDGE)
        if bare.isalpha():
            counts[bare] = counts.get(bare, 0) + k
        else:
            for w in _WORD.findall(bare):
                counts[w] = counts.get(w, 0) + k
        if len(t) <= 30 and (t[:-1] == bare and bare.isalpha() or _PLAIN.fullmatch(t)):
            continue
        if t[0] == "#":
            hashes += k * (len(t) > 1)
            continue
        bars += k * (t in _BARS)
        path = _PATH.match(t) is not None
        # letters, digits and symbols mixed, unless it is a file name, an email-like mark, a number or a time
        odd += k * (not path and _ODD.search(t) is not None and not _FILE.match(t.strip("().,;:…[]\"")))
        longest += k * (len(t) > 30 and not path and not _TAG.search(t))
        numbers += k * (_NUMBER.match(t) is not None or _HEX.match(t) is not None and any(c.isdigit() for c in t))
    if _CASE.search(text):
        breaks = sum(t[0] != "#" and _CASES.search(t) is not None for t in text.split())
    n, n_tokens, n_lines = sum(counts.values()), max(1, len(tokens)), max(1, len(lines))
    letters, latin, vowels, digits, symbols, chars = character_counts(text)
    hits = [0] * len(_LANGUAGES)
    known = [w for w in _COMMON if w in counts]
    for w in known:
        for lang in _COMMON[w]:
            hits[lang] += counts[w]
    best = hits.index(max(hits))
    # too few common words to tell: such a text is measured against the prose of all languages
    lang = _LANGUAGES[best] if hits[best] >= max(2, LEAST_COMMON * n) else ANY
    foreign = sum(counts[w] for w in known if best not in _COMMON[w] and len(w) > 1)
    sentences = len(_SENTENCE.findall(text))
    part_words = sorted(len(w) for x in lines for p in _PART.split(x) if (w := p.split()))
    items = marks = 0
    for x in lines:
        size = len(x.split())
        mark = _MARK.match(x)
        # a dash or number before whole sentences is speech or a paragraph, not an item
        marked = mark is not None and not (size > 6 and _SENTENCE.search(x, mark.end()))
        marks += marked
        items += marked or bool(_PATH.match(x.strip())) or (size <= 10 and len(lines) >= 3 and _NAMED.search(x) is not None and not _SENTENCE.search(x.rstrip(" :")))
    few = max(1, n)
    different = sum(len(set(tokens[i : i + WINDOW])) for i in range(0, len(tokens), WINDOW))
    stats = [
        n, sum(len(w) * k for w, k in counts.items()) / few, symbols / max(1, chars), sum(bool(_ENDS.search(x)) for x in lines) / n_lines, hits[best] / few, foreign / few,
        digits / max(1, chars), letters / max(1, chars), vowels / max(1, letters), max(counts.values(), default=0) / few, different / n_tokens,
        math.log1p(n / max(1, sentences)), math.log1p(part_words[len(part_words) // 2] if part_words else 0), math.log((len(part_words) + 1) / (sentences + 1)),
        marks / n_lines, items / n_lines, table, odd / n_tokens, longest / n_tokens, numbers / n_tokens, hashes / n_tokens, latin / max(1, letters), breaks / n_tokens,
        bars / n_tokens,
    ]
    return lang, [len(raw_lines), sentences, len(part_words)], [float(x) for x in stats]


def document_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang, counts, stats) of every document whose text is not blank; whole texts are read.

    counts holds the numbers of lines, sentences and parts, stats the values named
    by STATS. Null, empty and blank texts and null ids are left out; an empty
    table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body.strip().strip("\u200b\ufeff"):
                    for column, value in zip(out, (doc, *describe(body)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[key, "lang", "counts", "stats"])

    given = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return given.mapInArrow(run, f"`{key}` long, lang string, counts array<long>, stats array<double>")


_USED = np.arange(1, len(STATS))  # the word count describes a document but does not make it prose
_AT = {name: i for i, name in enumerate(STATS)}


def features(stats: np.ndarray) -> np.ndarray:
    """The statistics (columns of STATS) as they are measured by the distance; see _IN_TABLES and _IN_THE_MAIN."""
    x = stats.copy()
    rest = 1 - stats[:, _AT["table_lines"]]
    for name in _IN_TABLES:
        x[:, _AT[name]] *= rest
    x[:, _AT["latin_ratio"]] = 1 - (1 - x[:, _AT["latin_ratio"]]) * rest
    for name in _IN_THE_MAIN:
        x[:, _AT[name]] **= 3
    return x[:, _USED]


class ProseModel:
    """Mean and covariance of prose for each language, over the statistics that take part in the distance."""

    def __init__(self, centre: dict[str, np.ndarray], covariance: dict[str, np.ndarray]):
        self.centre, self.covariance = centre, covariance
        self.inverse = {k: np.linalg.inv(c) for k, c in covariance.items()}

    def squared(self, lang: str, x: np.ndarray) -> np.ndarray:
        """Contributions of each statistic (columns) to the squared distance of each row; they add up to it."""
        z = x - self.centre[lang]
        return z * (z @ self.inverse[lang])

    @property
    def languages(self) -> list[str]:
        return sorted(self.centre)


def _floor() -> np.ndarray:
    """The least standard deviation of each statistic: below it, differences mean nothing."""
    floor = np.full(len(STATS), 0.03)
    for name, value in {"mean_word_length": 0.35, "words_per_sentence": 0.35, "words_per_part": 0.35, "parts_per_sentence": 0.35, "line_end_ratio": 0.25, "distinct_ratio": 0.07,
                        "common_ratio": 0.06, "letter_ratio": 0.04}.items():
        floor[STATS.index(name)] = value
    return floor[_USED]


def fit_prose(stats: DataFrame) -> ProseModel:
    """Robust mean and covariance per language from all rows of ``stats`` (lang, stats), and over all languages for ANY.

    A language of n documents takes part of its estimate from all languages, the
    less the more documents it has (SHRINK), so that nothing switches at a size.
    """
    d, floor = len(_USED), _floor()

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k]) for k in range(d))], names=["lang", *(f"x{k}" for k in range(d))])

    told = stats.select("lang", "stats").where(F.col("lang") != ANY)
    both = told.unionByName(told.withColumn("lang", F.lit(ANY)))
    values = both.mapInArrow(measured, ", ".join(["lang string", *(f"x{k} double" for k in range(d))]))
    middle = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(1000))
    rows = values.groupBy("lang").agg(F.array(*[middle(F.col(f"x{k}")) for k in range(d)]).alias("m"), F.count(F.lit(1)).alias("n")).collect()
    centre = {r["lang"]: np.array(r["m"], float) for r in rows}
    if not centre:  # no document in any language: nothing is prose to compare with
        return ProseModel({ANY: np.zeros(d)}, {ANY: np.diag(floor**2)})
    medians = stats.sparkSession.createDataFrame([(k, [float(v) for v in m]) for k, m in centre.items()], "lang string, m array<double>")
    apart = values.join(F.broadcast(medians), "lang").select("lang", *[F.abs(F.col(f"x{k}") - F.col("m")[k]).alias(f"d{k}") for k in range(d)])
    spread = apart.groupBy("lang").agg(F.array(*[middle(F.col(f"d{k}")) for k in range(d)]).alias("s")).collect()
    model = ProseModel(centre, {r["lang"]: np.diag(np.maximum(1.4826 * np.array(r["s"], float), floor) ** 2) for r in spread})
    for _ in range(CONCENTRATION_STEPS):
        model = _concentrate(both, model, floor)
    for r in rows:
        lang, weight = r["lang"], r["n"] / (r["n"] + SHRINK)
        if lang != ANY:
            apart_by = model.centre[lang] - model.centre[ANY]
            model.centre[lang] = model.centre[ANY] + weight * apart_by
            model.covariance[lang] = weight * model.covariance[lang] + (1 - weight) * model.covariance[ANY] + weight * (1 - weight) * np.outer(apart_by, apart_by)
    return ProseModel(model.centre, model.covariance)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("stats")).flatten()).reshape(-1, len(STATS))


def _distances(batch: pa.RecordBatch, model: ProseModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    langs = np.array(batch.column(batch.schema.get_field_index("lang")).to_pylist(), dtype=object)
    x = features(_matrix(batch))
    parts = np.zeros_like(x)
    for lang in model.languages:
        own = langs == lang
        if own.any():
            parts[own] = model.squared(lang, x[own])
    return langs, x, parts


def _concentrate(stats: DataFrame, model: ProseModel, floor: np.ndarray) -> ProseModel:
    """One step: the documents nearest to the present estimate give the next one."""
    d = len(_USED)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, parts = _distances(batch, model)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts.sum(axis=1))], names=["lang", "d2"])

    cut = {r[0]: r[1] for r in stats.mapInArrow(measure, "lang string, d2 double").groupBy("lang").agg(F.percentile_approx("d2", F.lit(KEEP_QUANTILE), F.lit(1000))).collect()}

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            langs, x, parts = _distances(batch, model)
            total = parts.sum(axis=1)
            for lang in model.languages:
                near = x[(langs == lang) & (total <= cut.get(lang, np.inf))] - model.centre[lang]
                if len(near):
                    kept = sums.setdefault(lang, [0, np.zeros(d), np.zeros((d, d))])
                    kept[0] += len(near)
                    kept[1] += near.sum(axis=0)
                    kept[2] += near.T @ near
        if sums:
            names = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([float(sums[k][0]) for k in names]), pa.array([np.concatenate([sums[k][1], sums[k][2].ravel()]).tolist() for k in names], pa.list_(pa.float64()))],
                names=["lang", "n", "m"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for batch in batches:
            for lang, n, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept = total.setdefault(lang, [0.0, np.zeros(d + d * d)])
                kept[0] += n
                kept[1] += np.array(m)
        if total:
            names = list(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([total[k][0] for k in names]), pa.array([total[k][1].tolist() for k in names], pa.list_(pa.float64()))], names=["lang", "n", "m"]
            )

    # one row per partition and language, added up in a single task: a few kilobytes each
    shape = "lang string, n double, m array<double>"
    rows = stats.mapInArrow(moments, shape).repartition("lang").mapInArrow(add, shape).collect()
    sums: dict[str, tuple[float, np.ndarray]] = {}
    for lang, n, m in rows:
        before = sums.get(lang, (0.0, np.zeros(d + d * d)))
        sums[lang] = (before[0] + n, before[1] + np.array(m))
    centre, covariance = dict(model.centre), dict(model.covariance)
    for lang, (n, m) in sums.items():
        mean = m[:d] / n
        cov = m[d:].reshape(d, d) / n - np.outer(mean, mean)
        centre[lang] = model.centre[lang] + mean
        # shrunk towards its diagonal, never below the least deviations: constant statistics stay invertible
        own = np.diag(np.maximum(np.diag(cov), floor**2))
        weight = n / (n + 5.0 * d)
        covariance[lang] = weight * cov + (1 - weight) * own + np.diag(np.maximum(floor**2 - weight * np.diag(cov), 0.25 * floor**2))
    return ProseModel(centre, covariance)


def name_kinds(contributions: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """What outliers (rows) are: the kind whose signature contributes most to the squared distance.

    ``apart`` has the deviations from prose; a contribution speaks for a kind only
    in its direction. A text in which nothing shows the order of a list or table
    is junk; of equals the first of table, list, junk is named.
    """
    column = {name: k for k, name in enumerate(STATS[1:])}
    scores = []
    for signature in SIGNATURES.values():
        at, direction = [column[name] for name in signature], np.array(list(signature.values()))
        scores.append((np.maximum(contributions[:, at], 0) * (apart[:, at] * direction > 0)).sum(axis=1))
    scores[-1] = np.maximum(scores[-1], chi_square_quantile(EXPLAINED_QUANTILE, 1))
    return np.array(list(SIGNATURES), object)[np.argmax(np.stack(scores, axis=1), axis=1)]


def score_documents(stats: DataFrame, model: ProseModel, key: str = "doc_id") -> DataFrame:
    """``stats`` with distance2, outlier, kind and contributions (each statistic's part of the squared distance)."""
    cut = chi_square_quantile(OUTLIER_QUANTILE, len(_USED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, x, parts = _distances(batch, model)
            total = parts.sum(axis=1)
            outlier = total > cut
            kinds = np.full(len(total), None, object)
            kinds[outlier] = name_kinds(parts[outlier], x[outlier] - np.array([model.centre[lang] for lang in langs[outlier]]).reshape(-1, x.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(total), pa.array(outlier), pa.array(kinds, pa.string()), pa.array(parts.tolist(), pa.list_(pa.float64()))],
                names=[*batch.schema.names, "distance2", "outlier", "kind", "contributions"],
            )

    return stats.mapInArrow(run, f"`{key}` long, lang string, counts array<long>, stats array<double>, distance2 double, outlier boolean, kind string, contributions array<double>")


def judge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The scored statistics of every document that is not blank; see document_stats and score_documents."""
    stats = materialise(document_stats(docs, key, text), "stats")
    return score_documents(stats, fit_prose(stats), key)
