"""Keyword-stuffed and link-list pages by a word-class n-gram model.

Every page becomes a sequence of word classes: function words by language, kinds of content words, numbers, links, marks.
Content words that belong to a pair repeated densely on the page have classes of their own. A trigram model of classes is
trained on all prose units (sentences with function words and an end) of the whole corpus; its counts fit into a table of
fixed size. The surprisal of prose units gives the normal range, and a page is suspect if about a third of its characters lie
in units whose perplexity is abnormally high or low, or in the classes of densely repeated words, which prose has hardly.
An exact check of the suspects' texts then decides: a page is spam if more than half of its characters are dense keywords,
links without explaining sentences or lists of tags or goods.

Code, logs, table rows and key-value lines are never counted as spam, nor are headings. Null, empty and blank texts are no
cases. Each row is judged by itself, so repeated pages are all found. Very long texts are read whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docloom.operators.orphans import BloomFilter
from docloom.session import stash

_URL = r"https?://[^\s<>()\[\]\"'|,，]+"
_TOKEN = re.compile(_URL + r"|[一-鿿]|[A-Za-zÀ-ɏ_][A-Za-z0-9À-ɏ_'-]*|\d+(?:[.,:]\d+)*|\n+|[^\s]")
_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_LINK = re.compile(r"\[ANCHOR:[^\]]*\]|\[[^\]\n]{0,200}\]\(\s*" + _URL + r"\s*\)|<a\s[^>]*>[^<]{0,200}</a>|\[HLINK:[^\]]*\]|" + _URL)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_RECORD = re.compile(r"(?m)^.*\d{4}-\d\d-\d\d[T ]\d\d:\d\d.*$|^\s*\|.*\|\s*$|^\s*#{1,6} .*$|^【.*】\s*$")
_PAIR = re.compile(r"(?m)^\s*[A-Za-z][\w.-]*:[ \t]+\S.*$")
_UNIT = re.compile(r"[^\n。！？!?.]+(?:\.(?=\S)[^\n。！？!?.]*)*(?:[。！？!?.]+|\n|\Z)[ \t]*|[\n。！？!?.]+")
_WORD = re.compile(r"[一-鿿]|[A-Za-zÀ-ɏ_][A-Za-z0-9À-ɏ_'-]*")
_ITEM = re.compile(r"[\n,，、;；|·•»/\t]+|\s[-–—]\s|\s(?=[@#<]|tag:)")
_ONE = re.compile(r"(\w)\1{9,}")  # one character over and over is an odd word, no keyword
_MARKS = re.compile(r"[。！？；，]|[.!?;,:](?=\s|\Z)")
_LEET = dict(zip("01345@$", "oieasas"))

#: Function words and function characters.
ENGLISH = frozenset("a an and any are as at be because before but by can could does for from has have how if in is it its may nor not of on once only or so than that the their then there this to under until was we what when where which while who why will with would you your after all each when into no".split())
GERMAN = frozenset("aber als am auf aus bei bevor bis das dass dem den denn der des die durch ein eine einem einen einer es für gilt hat im in ist kein keine man mit muss nach nicht oder ohne sich sind sie sobald sodann über um und vom von vor wenn wer werden wie wird wir zu zum zur zwischen".split())
CHINESE = frozenset("的了在是和与及或不为以从到由把被将会要可就都也而但若如果则因所其这有并之于让向又再仅")
_EUROPEAN = ENGLISH | GERMAN
_HAN, _FUNCTION = re.compile("[一-鿿]"), re.compile("[" + "".join(sorted(CHINESE)) + "]")

CLASSES = ("start", "end", "line", "english", "german", "chinese", "han", "lower", "capital", "upper", "compound", "number", "link", "comma", "separator", "bracket", "quote", "other", "han+", "word+")
_ID = {name: i for i, name in enumerate(CLASSES)}
_REPEATABLE = {_ID["han"]: _ID["han+"], **{_ID[c]: _ID["word+"] for c in ("lower", "capital", "upper", "compound")}}
C = len(CLASSES)
#: A pair of content words is dense from this many times on, and once in so many words of the page.
DENSE_TIMES, DENSE_ONCE_IN = 4, 120


def word_class(token: str) -> int:
    """Class of one token by its form alone."""
    t, c = token.lower(), token[0]
    if "一" <= c <= "鿿":
        return _ID["chinese" if c in CHINESE else "han"]
    if c.isalpha() or c == "_":
        if t.startswith(("http://", "https://")):
            return _ID["link"]
        if t in ENGLISH:
            return _ID["english"]
        if t in GERMAN:
            return _ID["german"]
        if "-" in t or "_" in t or any(x.isupper() for x in token[1:]) and not token.isupper() or any(x.isdigit() for x in t):
            return _ID["compound"]
        return _ID["upper" if token.isupper() and len(token) > 1 else "capital" if c.isupper() else "lower"]
    if c.isdigit():
        return _ID["number"]
    if c == "\n":
        return _ID["line"]
    for name, marks in (("end", ".!?。！？"), ("comma", ",;:，、；："), ("separator", "|·•»→~+★☆/*#@>-–—"), ("bracket", "()[]{}（）【】<"), ("quote", "\"'`“”「」")):
        if c in marks:
            return _ID[name]
    return _ID["other"]


class Classifier:
    """Turns texts into class sequences; remembers the class and number of the tokens it has seen."""

    LIMIT = 400_000

    def __init__(self):
        self.known: dict[str, int] = {}
        self.kind = np.zeros(0, np.uint8)
        self.size = np.zeros(0, np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of each text, class of each token, characters of each token)."""
        words = [_TOKEN.findall(_INVISIBLE.sub("", t)) for t in texts]
        if len(self.known) > self.LIMIT:
            self.__init__()
        every = list(itertools.chain.from_iterable(words))
        fresh = sorted(set(every).difference(self.known))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        self.kind = np.concatenate([self.kind, np.array([word_class(w) for w in fresh], np.uint8)])
        self.size = np.concatenate([self.size, np.array([len(w) for w in fresh], np.int64)])
        n = np.array([len(w) for w in words], np.int64)
        word = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        kind, size = self.kind[word].copy(), np.where(self.kind[word] == _ID["line"], 0, self.size[word])
        doc = np.repeat(np.arange(len(n)), n)
        content = np.isin(kind, list(_REPEATABLE))
        if content.any():
            at = np.flatnonzero(content[:-1] & content[1:] & (doc[:-1] == doc[1:]))
            pair = (doc[at] * len(self.known) + word[at]) * len(self.known) + word[at + 1] if len(n) * len(self.known) ** 2 < 2**62 else doc[at] * 1_000_003 + word[at] * 998_244_353 + word[at + 1] * 7_919
            _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
            dense = times[inverse] >= np.maximum(DENSE_TIMES, n[doc[at]] / DENSE_ONCE_IN)
            plus = np.zeros(len(kind), bool)
            plus[at[dense]] = plus[at[dense] + 1] = True
            for plain, marked in _REPEATABLE.items():
                kind[plus & (kind == plain)] = marked
        return n, kind, size


def units(n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit number of each token (units end at sentence ends and lines) and the first token of each unit."""
    begin = np.zeros(len(kind), bool)
    starts = np.cumsum(n) - n
    begin[starts[n > 0]] = True
    stop = (kind == _ID["end"]) | (kind == _ID["line"])
    begin[1:] |= stop[:-1] & ~stop[1:]
    return np.cumsum(begin) - 1, np.flatnonzero(begin)


def is_prose(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Units that the model learns from: a sentence end, function words, no link, few repeated words."""
    count = lambda *names: np.add.reduceat(np.isin(np.arange(C), [_ID[x] for x in names]).astype(np.int32)[kind], first)
    size = np.diff(np.append(first, len(kind)))
    function = count("english", "german", "chinese")
    return (count("end") > 0) & (function >= 2) & (function * 12 >= size) & (count("link") == 0) & (count("han+", "word+") * 4 <= size)


def trigrams(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code of (class two before, class before, class) of each token; units begin with two starts."""
    k = kind.astype(np.int64)
    one, two = np.concatenate([[0], k[:-1]]), np.concatenate([[0, 0], k[:-2]])[: len(k)]
    one[first] = two[first] = _ID["start"]
    second = first + 1
    second = second[second < len(k)]
    second = second[~np.isin(second, first)]
    two[second] = _ID["start"]
    return (two * C + one) * C + k


def log_costs(counts: np.ndarray) -> np.ndarray:
    """Surprisal in bits of every trigram of classes: Witten-Bell smoothing over bigrams and single classes."""
    t = counts.reshape(C, C, C).astype(float)
    single = (t.sum((0, 1)) + 1) / (t.sum() + C)
    low = t.sum(0)
    kinds = (low > 0).sum(1, keepdims=True) + 1.0
    two = (low + kinds * single[None]) / (low.sum(1, keepdims=True) + kinds)
    kinds3 = (t > 0).sum(2, keepdims=True) + 1.0
    three = (t + kinds3 * two[None]) / (t.sum(2, keepdims=True) + kinds3)
    return -np.log2(three).ravel()


def _texts(batch: pa.RecordBatch, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    size = pa.compute.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).cumsum()
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + limit, "right")))
        yield batch.slice(a, b - a)
        a = b


def sequences(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, kinds, sizes): class (one byte) and size (four bytes) of each token, of every text that isn't blank; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier()
        for whole in batches:
            for batch in _texts(whole):
                n, kind, size = classify(batch.column("text").to_pylist())
                offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                wide = pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32) * np.int32(4))
                pack = lambda x, at: pa.Array.from_buffers(pa.binary(), len(n), [None, at, pa.py_buffer(x.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("key"), pack(kind.astype(np.uint8), offsets), pack(size.astype(np.uint32), wide)], ["key", "kinds", "sizes"])

    rows = documents.filter(F.length(F.btrim("text", F.lit(" \t\r\n　 "))) > 0).select(F.col(key).alias("key"), "text")
    return stash(rows.mapInArrow(run, f"key {documents.schema[key].dataType.simpleString()}, kinds binary, sizes binary"), "classes")


def _joined(column: pa.Array) -> tuple[np.ndarray, bytes]:
    values = column.to_pylist()
    return np.array([len(x) for x in values], np.int64), b"".join(values)


def _batch_kinds(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    n, kinds = _joined(batch.column("kinds"))
    return n, np.frombuffer(kinds, np.uint8)


def _batch_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return *_batch_kinds(batch), np.frombuffer(_joined(batch.column("sizes"))[1], np.uint32)


def train(seqs: DataFrame) -> np.ndarray:
    """Costs of all class trigrams, counted over the prose units of the whole corpus (a table of fixed size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(C**3, np.int64)
        for batch in batches:
            n, kind = _batch_kinds(batch)
            if not len(kind):
                continue
            unit, first = units(n, kind)
            total += np.bincount(trigrams(kind, first)[is_prose(kind, first)[unit]], minlength=C**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    got = seqs.select("kinds").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(C**3, np.int64)
    counts[got["code"].to_numpy()] = got["n"].to_numpy()
    return log_costs(counts)


def _surprisal(n: np.ndarray, kind: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    unit, first = units(n, kind)
    length = np.diff(np.append(first, len(kind)))
    return unit, first, np.add.reduceat(costs[trigrams(kind, first)], first) / length


def normal_range(seqs: DataFrame, costs: np.ndarray) -> tuple[float, float]:
    """Mean and standard deviation of the surprisal a token over all prose units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_all = s = q = 0.0
        for batch in batches:
            n, kind = _batch_kinds(batch)
            if not len(kind):
                continue
            _, first, bits = _surprisal(n, kind, costs)
            bits = bits[is_prose(kind, first)]
            n_all, s, q = n_all + len(bits), s + bits.sum(), q + (bits**2).sum()
        yield pa.RecordBatch.from_arrays([pa.array([n_all]), pa.array([s]), pa.array([q])], ["n", "s", "q"])

    row = seqs.select("kinds").mapInArrow(run, "n double, s double, q double").agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
    n, s, q = (x or 0.0 for x in row)
    if not n:
        return 2.0, 0.5
    return s / n, max(0.05, (q / n - (s / n) ** 2)) ** 0.5


def page_scores(seqs: DataFrame, costs: np.ndarray, mean: float, sd: float, width: float = 1.7) -> DataFrame:
    """(key, perplexity, abnormal): a page's perplexity and the share of its characters whose classes no prose has.

    These are units with a perplexity outside the normal range, and elsewhere the classes of densely repeated words.
    """
    repeated = np.isin(np.arange(C), [_ID["han+"], _ID["word+"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, kind, size = _batch_arrays(batch)
            perplexity, share = np.ones(len(n)), np.zeros(len(n))
            if len(kind):
                unit, first, bits = _surprisal(n, kind, costs)
                doc = np.repeat(np.arange(len(n)), n)
                odd = (np.abs(bits - mean) > width * sd)[unit] | repeated[kind]
                share = np.bincount(doc, size * odd, len(n)) / np.maximum(np.bincount(doc, size, len(n)), 1)
                perplexity = 2 ** (np.bincount(doc, costs[trigrams(kind, first)], len(n)) / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(perplexity), pa.array(share)], ["key", "perplexity", "abnormal"])

    return seqs.mapInArrow(run, f"key {seqs.schema['key'].dataType.simpleString()}, perplexity double, abnormal double")


def is_sentence(text: str, closed: bool = False) -> bool:
    """Whether a stretch of text reads like a sentence: enough words, of which enough are function words.

    Function characters are also parts of Chinese nouns, so without a mark of punctuation two different ones are asked for;
    with ``closed`` a mark has to be there in any language.
    """
    mark = _MARKS.search(text) is not None
    if closed and not mark:
        return False
    words = _WORD.findall(text.lower())
    han = len(_HAN.findall(text))
    other = len(words) - han
    marks, european = _FUNCTION.findall(text), sum(map(_EUROPEAN.__contains__, words))
    chinese = len(marks) if mark or len(set(marks)) >= 2 else 0
    if han >= 10 and chinese >= max(1, 0.05 * (han + other)) or other >= 6 and european >= max(2, 0.1 * other):
        return True
    return han + other >= 8 and other >= 3 and han >= 4 and chinese + european >= max(1, 0.06 * (han + other))


def _short_sentence(text: str) -> bool:
    """Whether a stretch of text ends as a sentence and has a few words with a function word among them: no item of a list."""
    if text.rstrip()[-1:] not in tuple(".!?。！？"):
        return False
    words = _WORD.findall(text.lower())
    return len(words) >= 4 and any(w in _EUROPEAN or w in CHINESE for w in words)


class Characters:
    """Of code points: whether it is a letter or digit, whether it is blank, and its folded form; filled as they are met."""

    def __init__(self):
        self.known, self.alnum, self.blank = (np.zeros(0x110000, bool) for _ in range(3))
        self.fold = np.arange(0x110000)

    def meet(self, code: np.ndarray) -> None:
        fresh = ~self.known[code]
        if not fresh.any():
            return
        for i in np.unique(code[fresh]).tolist():
            c, low = chr(i), chr(i).lower()
            self.known[i], self.alnum[i], self.blank[i] = True, c.isalnum(), c.isspace()
            self.fold[i] = ord(_LEET.get(c, low if len(low) == 1 else c))


_characters: list[Characters] = []


def _tables() -> Characters:
    """One in each worker."""
    if not _characters:
        _characters.append(Characters())
    return _characters[0]


class Runs:
    """Densely repeated runs of 4 Han or 6 other characters of one page: keywords, unless they belong to repeated sentences."""

    def __init__(self, code: np.ndarray, usable: np.ndarray, unit: np.ndarray, han: np.ndarray, once_in: int):
        self.n, self.found = len(code), []
        at = np.flatnonzero(usable)
        for width, kind in ((4, han), (6, ~han)):
            m = len(at) - width + 1
            begins = np.flatnonzero(kind[at][:m]) if m > 0 else ()
            if len(begins) < 4:
                continue
            c, h = code[at], np.zeros(m, np.int64)
            for j in range(width):
                h = h * 1_000_003 + c[j : m + j]
            # every start counts for how often a run comes, only those of the kind can be keywords
            least = max(4, len(at) / once_in)
            bins = (h ^ (h >> 31)) & ((1 << max(12, int(2 * m).bit_length())) - 1)
            often = np.flatnonzero(np.bincount(bins)[bins] >= least)  # a bin holds all starts of a run
            if not len(often):
                continue
            order = np.argsort(h[often], kind="stable")
            cut = np.flatnonzero(np.diff(h[often[order]], prepend=h[often[order[0]]] - 1))
            times = np.diff(np.append(cut, len(often)))
            number = np.empty(len(often), np.int64)
            number[order] = np.repeat(np.arange(len(cut)), times)
            chosen = np.flatnonzero((times >= least)[number])
            if not len(chosen):
                continue
            place, number = at[often[chosen]], number[chosen]
            _, first, many = np.unique(number * (int(unit[-1]) + 1) + unit[place], return_index=True, return_counts=True)
            mine = kind[place]
            self.found.append((width, at, often[chosen[mine]], number[mine], number[first], unit[place[first]], many, len(cut)))

    def units(self) -> np.ndarray:
        """Units that hold a dense run."""
        return np.unique(np.concatenate([f[5] for f in self.found])) if self.found else np.zeros(0, np.int64)

    def covered(self, plain: np.ndarray) -> np.ndarray:
        """Characters inside dense keywords: in a third of its units such a run is repeated, or the unit is no sentence (``plain``)."""
        out = np.zeros(self.n, bool)
        for width, at, starts, number, run, unit, many, size in self.found:
            keyword = (many >= 2) | plain[unit]
            good = np.bincount(run, keyword, size) >= 0.3 * np.maximum(np.bincount(run, minlength=size), 1)
            hit = starts[good[number]]
            for j in range(width):
                out[at[hit + j]] = True
        return out


class _Sentences:
    """Whether each unit of a page is no sentence; looked at when first asked for."""

    def __init__(self, text: str, bounds: list[tuple[int, int]]):
        self.text, self.bounds = text, bounds
        self.plain = np.zeros(len(bounds), bool)
        self.known = np.zeros(len(bounds), bool)

    def __getitem__(self, i: int) -> bool:
        if not self.known[i]:
            a, b = self.bounds[i]
            self.plain[i], self.known[i] = not is_sentence(self.text[a:b]), True
        return bool(self.plain[i])

    def of(self, units: Iterable[int]) -> np.ndarray:
        """The flags, settled for ``units``."""
        for i in units:
            self[i]
        return self.plain


def spam_share(text: str, least: float = 0.0) -> float:
    """Share of a page's visible characters that are dense keywords, bare links or lists of tags or goods.

    Of stuffed sentences only the characters inside keywords count, not the words and marks between them. Where it is plain
    that the share can't exceed ``least``, an upper bound not above it comes back instead of the share.
    """
    text = _INVISIBLE.sub("", text)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _tables()
    known.meet(raw)
    visible = ~known.blank[raw]
    total = int(visible.sum())
    if not total:
        return 0.0
    n = len(text)
    honest, links = np.zeros(n, bool), np.zeros(n, bool)
    fence = np.zeros(n, bool)  # never spam
    for m in _FENCE.finditer(text):
        fence[m.start() : m.end()] = True
    for m in _RECORD.finditer(text):
        if m.group().lstrip().startswith("#") or not _LINK.search(m.group()):
            fence[m.start() : m.end()] = True
    for m in _ONE.finditer(text):
        fence[m.start() : m.end()] = True
    honest |= fence
    for m in _PAIR.finditer(text):  # key-value lines: spam only if their values are dense keywords
        if not _LINK.search(m.group()):
            honest[m.start() : m.end()] = True
    spans = [m.span() for m in _LINK.finditer(text) if not honest[m.start()]]
    for i, (a, b) in enumerate(spans):
        before, after = text[spans[i - 1][1] if i else 0 : a], text[b : spans[i + 1][0] if i + 1 < len(spans) else n]
        if is_sentence(after.split("\n", 1)[0], True) or is_sentence(before.rsplit("\n", 1)[-1], True):
            continue
        links[a:b] = True
        if len(after) <= 120 and not is_sentence(after, True):
            links[b : b + len(after)] = True
        if len(before) <= 120 and not is_sentence(before, True):
            links[a - len(before) : a] = True
    bound = float((visible & (links | ~fence)).sum() / total)
    if bound <= least:
        return bound
    bounds = [m.span() for m in _UNIT.finditer(text)]
    unit = np.repeat(np.arange(len(bounds)), [b - a for a, b in bounds])
    plain = _Sentences(text, bounds)
    code = known.fold[raw]
    han = (code >= 0x4E00) & (code <= 0x9FFF)
    known.meet(code)
    body = (han | known.alnum[code]) & ~links & ~fence
    size = np.bincount(unit, body, len(bounds))
    full = lambda c: np.bincount(unit, c & body, len(bounds)) >= 0.4 * np.maximum(size, 1)
    runs = Runs(code, body, unit, han, 220)
    covered, stuffed = np.zeros(n, bool), np.zeros(len(bounds), bool)
    if runs.found:
        flags = plain.of(runs.units())
        covered = runs.covered(flags)
        stuffed = full(covered)
        if (stuffed & ~flags & plain.known).any():  # what comes again and again in stuffed sentences is a keyword too
            covered = runs.covered(flags | stuffed)
            stuffed = full(covered)
    linked, fenced = np.bincount(unit, links, len(bounds)), np.bincount(unit, fence, len(bounds))
    keyed = np.bincount(unit, honest & ~fence, len(bounds)) > 0
    length = np.bincount(unit, minlength=len(bounds))
    eligible = (size > 0) & (linked == 0) & (fenced <= 0.5 * length) & (stuffed | ~keyed)
    spam = links | covered & body
    bound = float((visible & (spam | eligible[unit] & ~fence)).sum() / total)
    if bound <= least:
        return bound
    items, listed = 0, np.zeros(n, bool)
    for i in np.flatnonzero(eligible):
        a, b = bounds[i]
        if not plain[i] and not stuffed[i] or _short_sentence(text[a:b]):
            continue
        parts = [x for x in _ITEM.split(text[a:b]) if x.strip()]
        if not plain[i]:  # stuffed: a list if no item is a sentence without its keywords
            rest = "".join(" " if hit else c for c, hit in zip(text[a:b], covered[a:b]))
            if len(parts) < 8 or any(map(is_sentence, _ITEM.split(rest))):
                continue
        listed[a:b] = ~fence[a:b]
        words = len(_WORD.findall(text[a:b]))
        items += max(len(parts), words // 2 if words >= 12 else 0)
    if items >= 8:
        spam |= listed
    return float((spam & visible).sum() / total)


def suspects(documents: DataFrame, key: str = "doc_id", least: float = 0.35) -> DataFrame:
    """(key, perplexity, abnormal) of the pages that the model finds abnormal: about a third of their characters lie where
    the classes are no prose. The bar is well below one half, as some stuffed sentences look normal."""
    seqs = sequences(documents, key)
    costs = train(seqs)
    mean, sd = normal_range(seqs, costs)
    return page_scores(seqs, costs, mean, sd).filter(F.col("abnormal") >= least).withColumnRenamed("key", key)


#: The case as the problem states it: more than half of the characters.
SPAM_SHARE = 0.5


def find_spam(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, perplexity, abnormal, share) of the spam pages; see the module's text. No documents: no rows."""
    # a key that came several times is looked at once for each of its rows, not for each pair of them
    found = suspects(documents, key).groupBy(key).agg(F.max("perplexity").alias("perplexity"), F.max("abnormal").alias("abnormal"))
    found = stash(found, "suspects")
    bloom = BloomFilter.of(found, key, found.count())
    # the filter keeps the texts of other pages out of the shuffle
    texts = documents.select(key, "text").filter(bloom.maybe(key)).join(found, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = pa.array([spam_share(t, SPAM_SHARE) if t else 0.0 for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("perplexity"), batch.column("abnormal"), share], ["key", "perplexity", "abnormal", "share"])

    kind = documents.schema[key].dataType.simpleString()
    judged = texts.select(F.col(key).alias("key"), "perplexity", "abnormal", "text").mapInArrow(run, f"key {kind}, perplexity double, abnormal double, share double")
    return judged.filter(F.col("share") > SPAM_SHARE).withColumnRenamed("key", key)
