"""Texts that lost their end.

Three kinds of evidence, each from statistics over all texts:

* near-copies: word shingles, min-hash banding, verified pairs; the copy whose alignment ends early is cut;
* ceilings: text lengths (characters or bytes) at which a source piles up far above the lengths around it, as a field limit
  makes it do: exactly at one length, or in the last dozen below it where a limit cuts between words;
* closing words: for a text that no copy tells about, the share of the places in the corpus where its closing words end a
  sentence or line. Words that occur nowhere but at the end of texts are broken words.

A text whose words equal those of a cut text is cut, too; so is a near-copy that ends at the same place as a cut text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.checkpoints import materialise
from palimpsest.llm.looks import look_tables
from palimpsest.partitions import spread

SHINGLE_WORDS = 5
SIMILAR = 0.8
#: 20 bands of 5 values: a pair at similarity 0.8 meets in some band with a chance of 0.9996.
BANDS, BAND_ROWS = 20, 5
#: Different texts in one bucket up to which its pairs are made by a join; a larger bucket is cut into blocks, and all blocks are compared.
BUCKET_PAIRS = 64
#: Texts, and shingles of all its texts, that one block of a large bucket holds on average.
BLOCK_TEXTS, BLOCK_SHINGLES = 1_000, 500_000
#: Columns of the 0/1 matrices that are multiplied to count what texts have in common.
COUNTED = 4_096
#: A length is a ceiling if this many different texts of a source have it, and so many times what lengths around it lead to expect.
CEILING_TEXTS, CEILING_TIMES = 6, 6
#: A limit leaves at most this share of a source's texts longer (it may hold for some time, or some records, only).
LONGER = 0.75
#: Lengths on either side that tell what to expect, and how far below a limit a cut between words may fall.
#: The nearest ones count by themselves, too, less the greatest of them (which may be a ceiling itself).
AROUND, BESIDE, WORD_SPAN = 50, 5, 12
#: Closing words end a sentence or line in less than this share of their places in the corpus: the text goes on.
CLOSING_SHARE = 0.1

#: Share of the texts with a closing mark that end there, and of a source's texts that have the same last words if these are no
#: part of what was written.
MARKED, FOOTER_SHARE = 0.98, 0.1
#: A word is rare if it has fewer places than this share of the number of texts.
RARE_WORD = 0.001
#: A last line of up to three words closes a text (a signature, an end mark) if texts stop there in this share of its places; texts
#: that are cut stop in fewer.
LAST_LINE_SHARE = 0.02

_WORD = regex.compile(
    r"https?://\S+|#\w+|\p{Han}|\p{N}+(?:[-/.,:]\p{N}+)*(?![\p{L}\p{N}])|[\p{L}\p{M}\p{N}]*\p{L}+(?:[-/'’](?=[\p{L}\p{N}])[\p{L}\p{M}\p{N}]+)*"
    r"|[\p{L}\p{N}]+|\n|[^\s\p{L}\p{N}]"
)
#: Marks that end a sentence.
ENDS = ".!?。！？…؟"


# --- closing words ---------------------------------------------------------------------------------------------------------


def word_class(w: str) -> str:
    """The class of a word or mark: numbers ``0``, words with digits ``ID``, links ``URL``, hash tags ``TAG``, capitalised words
    ``Xx``, all else itself."""
    c = w[0]
    if len(w) > 1:
        if c == "#":
            return "TAG"
        if w.startswith("http") and "://" in w:
            return "URL"
        if any(x.isdigit() for x in w):
            return "ID" if any(x.isalpha() for x in w) else "0"
        return "Xx" if c.isupper() and not w.isupper() else w
    return "0" if c.isdigit() else "Xx" if c.isupper() else w


#: Odd numbers that mix the hashes of words into the hash of a context.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
#: Kinds of words; the number of a word is its place in the tables of ``Words``.
START, LINE, MARK, HAN = 1, 2, 4, 8
_START, _BREAK, _BREAKS = range(3)
_AHEAD = 5


class Words(dict):
    """Numbers of the words that a worker has met, with the hash of each one's class (``own``; ``plain`` has one hash for all Chinese
    characters) and its kind. Hashes are the same in every worker; numbers are not."""

    def __init__(self) -> None:
        super().__init__({"\n": _BREAK, "\n\n": _BREAKS})
        line = [xxhash.xxh64_intdigest(w) for w in ("\n", "¶")]
        self.own, self.plain, self.kind = [94, *line], [94, *line], [START, LINE, LINE]

    def __missing__(self, w: str) -> int:
        han = "\u3400" <= w <= "\u9fff"
        h = xxhash.xxh64_intdigest(word_class(w))
        self.own.append(h)
        self.plain.append(xxhash.xxh64_intdigest("字") if han else h)
        self.kind.append((MARK if w in ENDS else 0) | (HAN if han else 0))
        self[w] = len(self.own) - 1
        return len(self.own) - 1


_words = Words()


def _mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), kind, dtype=np.uint64)
        for part in parts:
            out = (out ^ part) * _MIX[0]
            out ^= out >> np.uint64(29)
            out *= _MIX[1]
        return out.view(np.int64)


class Places:
    """The words of many texts in a row, with the contexts of every place. A run of blanks is nothing, a run of line breaks is one
    word; a Chinese character is a word. Before each text stand a few words that tell that it starts there."""

    def __init__(self, texts: list[str]):
        global _words
        if len(_words) > 300_000:
            _words = Words()
        parts = [np.zeros(_AHEAD, np.int32)]
        for text in texts:
            words = _WORD.findall(text)
            parts += [np.fromiter(map(_words.__getitem__, words), np.int32, len(words)), parts[0]]
        at = np.concatenate(parts)
        lines = at == _BREAK
        run = lines & np.roll(lines, 1)
        at[lines & np.roll(lines, -1) & ~run] = _BREAKS
        at = at[~run]
        own, plain, kind = (np.array(x, t)[at] for x, t in ((_words.own, np.uint64), (_words.plain, np.uint64), (_words.kind, np.uint8)))
        self.own, self.plain, self.kind, n = own, plain, kind, len(at)
        self.start, self.line, self.mark, self.han = ((kind & k) > 0 for k in (START, LINE, MARK, HAN))
        place = np.arange(n)
        self.text = np.cumsum(self.start) // _AHEAD - 1
        self.nth = place - np.maximum.accumulate(np.where(self.start, place, 0)) - 1
        self.last = ~self.start & np.roll(self.start, -1)
        self.before_break = np.maximum.accumulate(np.where(self.start | self.line, place, 0))

    def contexts(self, at: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """(kind, places, hashes) of the contexts of the places ``at``: the last three, two and one words (kinds 3, 2, 1); after a
        Chinese character also the two characters before the last three, and before the last two, which names of people fill (``w``,
        ``v``); within the first three words of a line but the first also the line's words with the end of the line before (``S``),
        and with nothing but the kind of break (``P``)."""
        h = self.own
        yield "3", at, _mixed(3, h[at - 2], h[at - 1], h[at])
        yield "2", at, _mixed(2, h[at - 1], h[at])
        yield "1", at, _mixed(1, h[at])
        han = at[self.han[at] & (self.nth[at] > 4)]
        yield "w", han, _mixed(5, h[han - 4], h[han - 3])
        yield "v", han, _mixed(6, h[han - 3], h[han - 2])
        lines = at[self.line[self.before_break[at]] & (at - self.before_break[at] <= 3) & ~self.line[at]]
        broke = self.before_break[lines]
        nth, g, none = lines - broke, self.plain, np.uint64(0)
        words = np.where(nth > 2, g[lines - 2], none), np.where(nth > 1, g[lines - 1], none), g[lines]
        yield "S", lines, _mixed(7, h[broke - 2], h[broke - 1], h[broke], *words)
        yield "P", lines, _mixed(8, h[broke], *words)


def in_parts(texts: list[str], chars: int = 500_000) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of runs of texts with about so many characters, or one longer text."""
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= chars or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0


def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, places, ends): how often contexts occur inside the texts of a batch, and how often a sentence or line ends
    right after them (of a line's words: the line). Places at the very end of a text don't count."""
    for batch in batches:
        for _, texts in in_parts([t.rstrip() for t in batch.column(0).to_pylist()]):
            p = Places(texts)
            at = np.flatnonzero(~(p.start | p.line | p.mark | p.last))
            hashes, ended = [], []
            for kind, places, found in p.contexts(at):
                hashes.append(found)
                ended.append(p.line[places + 1] | (p.mark[places + 1] if kind not in "SP" else False))
            names, place = np.unique(np.concatenate(hashes), return_inverse=True)
            ends = np.bincount(place, weights=np.concatenate(ended), minlength=len(names)).astype(np.int64)
            columns = [pa.array(names), pa.array(np.bincount(place, minlength=len(names)).astype(np.int64)), pa.array(ends)]
            yield pa.RecordBatch.from_arrays(columns, names=["context", "places", "ends"])


#: Characters at the end of a text that are looked at first for its closing contexts.
CLOSING_CHARS = 300
_CUT = regex.compile(r"\s|(?=\p{Han})")


def closing_part(text: str) -> str:
    """The end of a text that all contexts of its last place are in, or the whole text. Contexts reach back over five words, and
    from the first three words of a line over the three before it. The end begins after a blank or before a Chinese character,
    where no word is cut."""
    at = len(text)
    while at > CLOSING_CHARS:
        at = max(0, at - CLOSING_CHARS)
        if not (start := _CUT.search(text, at)):
            continue
        end = text[start.end() :]
        line = end.rfind("\n")
        if len(_WORD.findall(end[:line] if line >= 0 else end)) > _AHEAD + 2:
            return end
    return text


def closings(texts: list[str]) -> tuple[list[list[bool]], pa.ListArray]:
    """((marked, broken, small) of every text's end, its contexts): whether a mark closes it, whether its last character is a
    broken one, whether its last word is in small letters of an alphabet; the contexts of its last place as (kind, context)."""
    flags: list[list[bool]] = [[], [], []]
    owners, kinds, hashes = [], [], []
    for first, part in in_parts([closing_part(t.rstrip()) for t in texts]):
        for t in part:
            last = t[-1:]
            word = _WORD.findall(t, max(0, t.rfind(" ") + 1, t.rfind("\n") + 1))[-1:]
            flags[0].append(bool(last) and not last.isalnum() and last not in ",-–—:;&/(\ufffd" and not last.isspace())
            flags[1].append(last == "\ufffd")
            flags[2].append(bool(word) and word[0].isalpha() and word[0].islower() and not "\u3400" <= word[0] <= "\u9fff")
        p = Places(part)
        ends = np.flatnonzero(p.last)
        short = p.nth[ends] < 2  # where texts begin they do not end, so only a plain word itself tells
        small = np.array(flags[2][first:])[p.text[ends]] if len(ends) else short
        for kind, at, found in p.contexts(ends):
            kept = ~np.isin(at, ends[short]) if kind != "1" else ~short | small
            owners.append(first + p.text[at[kept]])
            kinds.append(np.full(int(kept.sum()), ord(kind), np.uint8))
            hashes.append(found[kept])
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    sizes = np.bincount(owner, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    kind = pa.array([chr(k) for k in np.concatenate(kinds)[order]] if owners else [], pa.string())
    values = pa.StructArray.from_arrays([kind, pa.array(np.concatenate(hashes)[order] if owners else np.zeros(0, np.int64))], names=["kind", "context"])
    return flags, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


# --- ceilings --------------------------------------------------------------------------------------------------------------


def ceilings(lengths: DataFrame) -> DataFrame:
    """(source, measure, length, exact, odds): lengths at or just under a limit, from (source, measure, length, words) of all texts.

    Texts with equal words count once, so that copies of one text make no ceiling. ``exact`` is true for a length at which a
    source piles up by itself, false for one of the dozen lengths below the longest of a pile. ``odds`` is how many times more texts
    there are than lengths around lead to expect (of which less than half a text counts as half). The window runs over the histogram,
    which has at most one row for each length of a source.
    """
    histogram = lengths.distinct().groupBy("source", "measure", "length").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("source", "measure")
    near = whole.orderBy("length")
    total = lambda lo, hi: F.coalesce(F.sum("n").over(near.rangeBetween(lo, hi)), F.lit(0))
    most = lambda lo, hi: F.coalesce(F.max("n").over(near.rangeBetween(lo, hi)), F.lit(0))
    beside = total(-BESIDE, -1) + total(1, BESIDE) - F.greatest(most(-BESIDE, -1), most(1, BESIDE))
    piled = histogram.select(
        "*",
        F.greatest((total(-AROUND, -1) + total(1, AROUND)) / (2 * AROUND), beside / (2 * BESIDE - 1)).alias("expected"),
        total(1 - WORD_SPAN, 0).alias("last"),
        total(1 - 4 * WORD_SPAN, -WORD_SPAN).alias("below"),
        total(1, 2 * WORD_SPAN).alias("above"),
        (F.coalesce(F.sum("n").over(near.rangeBetween(1, Window.unboundedFollowing)), F.lit(0)) / F.sum("n").over(whole)).alias("longer"),
    ).where(F.col("longer") <= LONGER)
    exact = piled.where((F.col("n") >= CEILING_TEXTS) & (F.col("n") >= CEILING_TIMES * F.col("expected")))
    edge = piled.where(
        (F.col("last") >= 2 * CEILING_TEXTS) & (F.col("last") >= CEILING_TIMES * F.col("above")) & (F.col("last") >= F.col("below"))
    )
    under = F.explode(F.sequence(F.col("length") - (WORD_SPAN - 1), F.col("length"))).alias("length")
    return (
        exact.select("source", "measure", "length", F.lit(True).alias("exact"), (F.col("n") / F.greatest("expected", F.lit(0.5))).alias("odds"))
        .unionByName(edge.select("source", "measure", under, F.lit(False).alias("exact"), (F.col("last") / F.greatest("above", F.lit(0.5))).alias("odds")))
        .groupBy("source", "measure", "length")
        .agg(F.max("exact").alias("exact"), F.max("odds").alias("odds"))
    )


# --- near-copies -----------------------------------------------------------------------------------------------------------


@cache
def _letters() -> np.ndarray:
    """By code point: 1 for what words are made of (letters, marks, digits), 2 for Chinese characters, which are words, else 0."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, form in ((1, r"[\p{L}\p{M}\p{N}_]+"), (2, r"\p{Han}+")):
        for m in regex.finditer(form, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = value
    return out


_GONE = 0xFFFFFFFF


@cache
def _looks() -> tuple[np.ndarray, regex.Pattern]:
    """By code point, the one that it looks like (see ``looks``); and what finds characters that look like several."""
    out = np.arange(0x110000, dtype=np.uint32)
    from_, to, longer = look_tables()
    out[[ord(c) for c in from_]] = [ord(c) for c in to] + [_GONE] * (len(from_) - len(to))
    return out, regex.compile("[" + "".join(longer) + "]")


@cache
def _visible() -> regex.Pattern:
    """What finds a character that is neither blank nor invisible."""
    from_, to, _ = look_tables()
    blank = [c for c, x in zip(from_, to, strict=False) if x == " "] + list(from_[len(to) :])
    return regex.compile("[^ \\t\\n\\r" + "".join(map(regex.escape, blank)) + "]")


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number modulo 2 ** 64, and of its inverse."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (_MIX[0], np.uint64(pow(int(_MIX[0]), -1, 1 << 64))))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, numbers of texts) of all words of the texts in order, in lower case and with every character as the one that it looks
    like: polynomials of their code points."""
    looks_like, longer = _looks()
    texts = [t.lower() for t in texts]
    texts = [longer.sub(lambda m: look_tables()[2][m[0]].lower(), t) if longer.search(t) else t for t in texts]
    points = looks_like[np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    seen = points != _GONE
    bounds = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate([[0], np.cumsum(seen)])[np.minimum(bounds, len(points))]
    points = points[seen]
    kind = _letters()[points]
    start = (kind == 2) | ((kind == 1) & (np.concatenate([[0], kind[:-1]]) != 1))
    end = (kind == 2) | ((kind == 1) & (np.concatenate([kind[1:], [0]]) != 1))
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _powers(1 << max(4, len(points).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(points.astype(np.uint64) * up[: len(points)])])
        h = (sums[last] - sums[first]) * down[first]
        h = (h ^ (h >> np.uint64(31))) * _MIX[1]
        h ^= h >> np.uint64(29)
    return h, np.searchsorted(bounds, first, side="right")


def shingled(batch: list[str]) -> tuple[list[int], pa.ListArray]:
    """For each text a hash of all its words in order, and the hashes of its word shingles in the order in which they first
    occur. A text with fewer words than a shingle has none."""
    whole, shingles = [], []
    for _, texts in in_parts(batch):
        h, owner = word_hashes(texts)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        n = max(0, len(h) - SHINGLE_WORDS + 1)
        with np.errstate(over="ignore"):
            rolled = h[:n].copy()
            for k in range(1, SHINGLE_WORDS):
                rolled = rolled * _MIX[2] + h[k : n + k]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            whole.append(xxhash.xxh64_intdigest(h[lo:hi].tobytes()) - (1 << 63))
            own = rolled[lo : max(lo, hi - SHINGLE_WORDS + 1)]
            _, first = np.unique(own, return_index=True)
            shingles.append(own[np.sort(first)].view(np.int64))
    ends = np.cumsum([0, *map(len, shingles)], dtype=np.int32)
    return whole, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(shingles) if shingles else np.zeros(0, np.int64)))


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, words, shingles) of texts (doc, text)."""
    for batch in batches:
        whole, shingles = shingled(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.int64()), shingles], names=["doc", "words", "shingles"])


MEASURED = "doc long, source string, chars int, bytes int, words long, shingles array<long>, marked boolean, broken boolean, small boolean, contexts array<struct<kind:string,context:long>>"


def measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All that is known of each text (doc, source, text) with a visible character, by itself."""
    for batch in batches:
        seen = [bool(_visible().search(t)) for t in batch.column(2).to_pylist()]
        batch = batch.filter(pa.array(seen, pa.bool_()))
        texts = batch.column(2).to_pylist()
        whole, shingles = shingled(texts)
        flags, contexts = closings(texts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(map(len, texts), pa.int32()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int32()),
                pa.array(whole, pa.int64()), shingles, *[pa.array(f, pa.bool_()) for f in flags], contexts,
            ],
            names=["doc", "source", "chars", "bytes", "words", "shingles", "marked", "broken", "small", "contexts"],
        )


def band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, words, n, band): a hash for each band of the min-hash signature of each (doc, words, shingles); n is the number of shingles."""
    half = BANDS * BAND_ROWS // 2  # each 64-bit hash serves as two of 32 bits
    seeds = np.random.default_rng(5).integers(1, 1 << 62, (2, half), dtype=np.uint64)
    for batch in batches:
        docs, whole, sizes, bands = [], [], [], []
        for doc, words, values in zip(batch["doc"].to_pylist(), batch["words"].to_pylist(), batch["shingles"], strict=True):
            own = np.asarray(values.values).view(np.uint64)
            if not len(own):
                continue
            lowest = np.full((half, 2), np.iinfo(np.uint32).max, np.uint32)
            with np.errstate(over="ignore"):
                for at in range(0, len(own), 4096):
                    mixed = own[at : at + 4096, None] * (seeds[0] | np.uint64(1)) + seeds[1]
                    mixed ^= mixed >> np.uint64(29)
                    mixed *= np.uint64(0xBF58476D1CE4E5B9)
                    mixed ^= mixed >> np.uint64(31)
                    np.minimum(lowest, mixed.view(np.uint32).reshape(*mixed.shape, 2).min(axis=0), out=lowest)
                signature = lowest.reshape(BANDS, BAND_ROWS).astype(np.uint64)
                band = (signature * (np.uint64(0x100000001B3) ** np.arange(1, BAND_ROWS + 1, dtype=np.uint64))).sum(axis=1)
                band = band * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)
            docs += [doc] * BANDS
            whole += [words] * BANDS
            sizes += [len(own)] * BANDS
            bands.append(band.view(np.int64))
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(whole, pa.int64()), pa.array(sizes, pa.int32()), pa.array(flat)], names=["doc", "words", "n", "band"])


def flattened(lists: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, rows, sizes) of lists of 64-bit numbers: ``rows`` has the number of the list that each value is in."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes), sizes


def common_counts(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """How many values each row of ``a`` has in common with each row of ``b``, both as (values, rows) without repeats in a row."""
    known = np.intersect1d(a[0], b[0])
    out = np.zeros(shape, np.float32)

    def placed(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(known, values)
        found = at < len(known)
        found[found] = known[at[found]] == values[found]
        order = np.argsort(at[found], kind="stable")
        return at[found][order], rows[found][order]

    if len(known):
        (at_a, rows_a), (at_b, rows_b) = placed(*a), placed(*b)
        for low in range(0, len(known), COUNTED):
            width = min(COUNTED, len(known) - low)
            sides = []
            for at, rows, n in ((at_a, rows_a, shape[0]), (at_b, rows_b, shape[1])):
                lo, hi = np.searchsorted(at, [low, low + width])
                side = np.zeros((n, width), np.float32)
                side[rows[lo:hi], at[lo:hi] - low] = 1
                sides.append(side)
            out += sides[0] @ sides[1].T
    return out


def goes_on_by(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each row of ``a`` and of ``b`` the shingles that b has after the last but one of a; -1 if b does not have that."""
    ends = np.cumsum(a[2])
    out = np.full((len(a[2]), len(b[2])), -1, np.int64)
    long = np.flatnonzero(a[2] > 1)
    keys, key_of = np.unique(a[0][ends[long] - 2], return_inverse=True)
    if not len(keys):
        return out
    at = np.minimum(np.searchsorted(keys, b[0]), len(keys) - 1)
    hit = np.flatnonzero(keys[at] == b[0])
    rows = b[1][hit]
    after = np.full((len(keys), len(b[2])), -1, np.int64)
    after[at[hit], rows] = np.cumsum(b[2])[rows] - hit - 2
    # a text that ends with that shingle has -1 after it, as one less than nothing; keep it apart from "not found"
    after[at[hit], rows] = np.where(after[at[hit], rows] < 0, -2, after[at[hit], rows])
    out[long] = after[key_of]
    return out


def compare_blocks(cell: pa.Table) -> pa.Table:
    """(a, b, a_short, b_short): the verified pairs of one cell (band, i, j, block, doc, shingles, small, large) of a large bucket.

    Each text of block i meets each text of block j. A pair that also meets in a small bucket is left to that; one that meets
    in several large ones, to the lowest of them.
    """
    band, i, j = (cell[c][0].as_py() for c in ("band", "i", "j"))
    block = cell["block"].to_numpy()
    sides = []
    for k in (i, j):
        own = cell.filter(pa.array(block == k))
        small, large = flattened(own["small"]), flattened(own["large"])
        lower = large[0] < band
        before = (np.concatenate([small[0], large[0][lower]]), np.concatenate([small[1], large[1][lower]]))
        sides.append((own["doc"].to_numpy(), before, flattened(own["shingles"])))
    (doc_a, before_a, a), (doc_b, before_b, b) = sides
    shape = (len(doc_a), len(doc_b))
    meet = common_counts(before_a, before_b, shape) == 0
    if i == j:
        meet &= doc_a[:, None] < doc_b[None, :]
    x = y = np.zeros(0, np.int64)
    if meet.any():
        common = common_counts(a[:2], b[:2], shape).astype(np.float64)
        x, y = np.nonzero(meet & (common >= SIMILAR * (a[2][:, None] + b[2][None, :] - common)))
    columns = [doc_a[x], doc_b[y]]
    shorts = [np.zeros(0, np.int64)] * 2 if not len(x) else [goes_on_by(a, b)[x, y], goes_on_by(b, a)[y, x]]
    swap = columns[0] > columns[1]
    columns = [np.where(swap, columns[1], columns[0]), np.where(swap, columns[0], columns[1])]
    shorts = [np.where(swap, shorts[1], shorts[0]), np.where(swap, shorts[0], shorts[1])]
    shorts = [pa.array(np.where(v == -2, -1, v).astype(np.int32), mask=v == -1) for v in shorts]
    return pa.Table.from_arrays([*map(pa.array, columns), *shorts], names=["a", "b", "a_short", "b_short"])


def near_copies(texts: DataFrame) -> DataFrame:
    """(a, b, a_short, b_short): verified pairs among texts (doc, words, shingles), by similarity of their shingle sets. Texts of equal
    ``words`` are one, that of the smallest doc; without such a column all are different.

    ``a_short``: shingles that b has after the place where a ends, null if a's end is not found in b; ``b_short`` likewise.
    All pairs that meet in a bucket are verified. Buckets of up to ``BUCKET_PAIRS`` texts make theirs by a join; a larger one is
    cut into blocks, each pair of which is one group of rows of bounded size, whatever the size of the bucket.
    """
    texts = texts if "words" in texts.columns else texts.withColumn("words", F.col("doc"))
    banded = texts.select("doc", "words", "shingles").mapInArrow(band_rows, "doc long, words long, n int, band long")
    banded = banded.groupBy("band", "words").agg(F.min("doc").alias("doc"), F.max("n").alias("n"))  # copies meet in all their bands
    banded = materialise(banded.select("doc", "n", "band"), "bands")
    buckets = banded.groupBy("band").agg(F.count("*").alias("many"), F.sum(F.col("n").cast("long")).alias("total"))
    buckets = materialise(buckets.where("many > 1"), "buckets")
    few = banded.join(buckets.where(F.col("many") <= BUCKET_PAIRS).select("band"), "band").select("band", "doc")
    pairs = few.join(few.withColumnRenamed("doc", "other"), "band").where("doc < other").select("doc", "other").distinct()
    # written first, so that only the shingles of texts in a pair are moved
    pairs = materialise(pairs, "candidates")
    wanted = pairs.select("doc").unionByName(pairs.select(F.col("other").alias("doc"))).distinct()
    compared = materialise(texts.select("doc", "shingles").join(wanted, "doc", "left_semi"), "compared")
    one = compared.select(F.col("doc"), F.col("shingles").alias("s_a"))
    other = compared.select(F.col("doc").alias("other"), F.col("shingles").alias("s_b"))
    both = pairs.join(one, "doc").join(other, "other")
    common = F.size(F.array_intersect("s_a", "s_b"))
    close = both.where(common >= SIMILAR * (F.size("s_a") + F.size("s_b") - common))

    def goes_on(a: str, b: str) -> Column:
        at = F.array_position(b, F.try_element_at(a, F.lit(-2)))  # the last shingle but one: the last word may be broken
        return F.when((F.size(a) > 1) & (at > 0), (F.size(b) - at - 1).cast("int"))

    out = close.select(F.col("doc").alias("a"), F.col("other").alias("b"), goes_on("s_a", "s_b").alias("a_short"), goes_on("s_b", "s_a").alias("b_short"))
    large = buckets.where(F.col("many") > BUCKET_PAIRS)
    if large.isEmpty():
        return out
    hot = materialise(banded.join(large, "band").select("doc", "band", "many", "total"), "hot")
    met = hot.groupBy("doc").agg(F.collect_list("band").alias("large"))
    met = met.join(few.groupBy("doc").agg(F.collect_list("band").alias("small")), "doc", "left")
    met = met.select("doc", "large", F.coalesce("small", F.array().cast("array<long>")).alias("small"))
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK_TEXTS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    cells = hot.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    cells = cells.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("band", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "doc")
    cells = cells.join(met, "doc").join(texts.select("doc", "shingles"), "doc").select("band", "i", "j", "block", "doc", "shingles", "small", "large")
    return out.unionByName(cells.groupBy("band", "i", "j").applyInArrow(compare_blocks, "a long, b long, a_short int, b_short int"))


# --- all evidence ----------------------------------------------------------------------------------------------------------


def judged_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, cut, evidence) of every document with a text that has a visible character.

    ``evidence`` is ``copy``, ``ceiling``, ``closing`` or ``equal`` (words equal to, or near-copy with the same end as, a cut
    text); null where ``cut`` is false. Null, empty and blank texts are no case and give no row. A text without a closing mark
    is not cut for that. ``doc_id`` must be unique; a null source counts as a source. No documents give no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("source", F.lit("")).alias("source"), "text")
    docs = spread(docs.where("text <> ''"), "doc")
    measured = materialise(docs.select("doc", "source", "text").mapInArrow(measure_rows, MEASURED), "measured")
    words = measured.select("doc", "words")

    # ceilings
    measure = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in ("chars", "bytes")]))
    lengths = measured.select("doc", "source", "words", "marked", measure.alias("m")).select("doc", "source", "words", "marked", "m.*")
    limits = materialise(ceilings(lengths.select("source", "measure", "length", "words")), "limits")
    limit = ["source", "measure", "length"]
    piled = lengths.join(limits, limit).where(F.col("exact") | ~F.col("marked"))
    tails = piled.groupBy(*limit).agg(F.avg(F.col("marked").cast("int")).alias("marked_piled"))
    piled = piled.join(tails, limit).groupBy("doc", "source", "marked").agg(F.max(F.struct("odds", "marked_piled")).alias("m")).select("doc", "source", "marked", "m.*")
    # a mark tells little where texts at the limit have one as often as others, since what cut them put it there
    others = measured.join(piled.select("doc"), "doc", "left_anti").groupBy("source").agg(F.avg(F.col("marked").cast("int")).alias("marked_else"))
    usual, seldom = F.coalesce("marked_else", F.lit(MARKED)), F.lit(1 - MARKED)
    mark = (usual + seldom) / (usual + F.col("marked_piled") + 2 * seldom)
    lack = (1 - usual + seldom) / (2 - usual - F.col("marked_piled") + 2 * seldom)
    # neither do the last words where many texts of the source have them
    last = measured.select("doc", "source", F.get(F.filter("contexts", lambda c: c["kind"] == "3"), F.lit(0))["context"].alias("last"))
    footers = last.groupBy("source", "last").agg(F.count("*").alias("n")).join(last.groupBy("source").agg(F.count("*").alias("all")), "source")
    footers = footers.where((F.col("n") >= CEILING_TEXTS) & (F.col("n") >= FOOTER_SHARE * F.col("all"))).select("source", "last", F.lit(True).alias("footer"))
    piled = piled.join(others, "source", "left").join(last.drop("source"), "doc").join(footers, ["source", "last"], "left")
    piled = piled.select("doc", "odds", F.when(F.col("marked"), mark).otherwise(lack).alias("mark"), F.coalesce("footer", F.lit(False)).alias("footer"))
    piled = materialise(piled, "piled")

    # closing words: the finals of texts below any ceiling count as ends of their contexts
    scored = measured.join(piled, "doc", "left").select("doc", "odds", "mark", "footer", "broken", "small", "marked", F.explode_outer("contexts").alias("c"))
    scored = scored.select("doc", "odds", "mark", "footer", "broken", "small", "marked", "c.*").withColumn("free", F.when(F.col("odds").isNull(), 1).otherwise(0))
    finals = materialise(scored.where("context IS NOT NULL").groupBy("context").agg(F.sum("free").alias("finals")), "finals")
    places = docs.select("text").mapInArrow(count_contexts, "context long, places long, ends long")
    places = places.join(finals.select("context"), "context", "left_semi")  # most contexts of a corpus end no text
    known = places.groupBy("context").agg(F.sum("places").alias("places"), F.sum("ends").alias("ends"))
    known = materialise(finals.join(known, "context", "left").na.fill(0, ["places", "ends"]), "contexts")
    others = F.col("finals") - F.col("free")
    share = (F.col("ends") + others) / (F.col("places") + others)
    seen = F.col("places") + others >= 5
    kind = F.col("kind")
    best = (
        scored.join(known, "context", "left")
        .groupBy("doc", "odds", "mark", "footer", "broken", "small", "marked")
        .agg(
            F.max(F.when(seen & kind.isin("1", "2", "3"), F.struct(kind.alias("level"), share.alias("share")))).alias("best"),
            F.max(F.when(seen & kind.isin("v", "w"), share)).alias("around_names"),
            F.max(F.when(kind.isin("S", "P") & (others >= 3), share)).alias("last_line"),
            F.max(F.when(kind == "1", F.col("places"))).alias("word_places"),
            F.max(F.when(kind == "2", F.col("places"))).alias("pair_places"),
        )
    )
    best = best.select("*", "best.*")
    # a word that is unknown inside texts, or a rare one after a word that it follows nowhere else
    rare = RARE_WORD * measured.count()
    broken_word = F.col("small") & ((F.col("word_places") == 0) | ((F.col("word_places") < rare) & (F.coalesce("pair_places", F.lit(0)) == 0)))
    ends_well = F.coalesce(F.col("around_names") >= CLOSING_SHARE, F.lit(False)) | F.coalesce(
        F.col("last_line") >= LAST_LINE_SHARE, F.lit(False)
    )
    share = F.coalesce(F.when(F.col("level") == "1", 5 * F.col("share")).otherwise(F.col("share")), F.lit(0.5))  # one word alone says little
    by_words = F.when(ends_well, F.greatest(share, F.lit(0.5))).when(broken_word, 0.0).otherwise(F.least(share, F.lit(1.0)))
    # at a limit both the words and what closes the others count, as far as either tells anything
    said = F.when(F.col("footer") | F.col("marked"), 0.5).otherwise(F.least(by_words, F.lit(0.9)))
    both = said * F.col("mark") / (said * F.col("mark") + (1 - said) * (1 - F.col("mark")))
    alone = F.when(F.col("marked"), MARKED).otherwise(by_words)
    terminal = F.when(F.col("broken"), 0.0).when(F.col("odds").isNotNull(), F.least(both, alone)).otherwise(alone)
    # a text goes on if the odds that its end is none, times those of its length, exceed those of a share at the bound
    bound = (1 - CLOSING_SHARE) / CLOSING_SHARE
    judged = best.withColumn("terminal", terminal)
    goes_on = lambda odds: odds * (1 - F.col("terminal")) > bound * F.col("terminal")
    open_end = judged.where(goes_on(F.lit(1.0))).select("doc")
    at_limit = judged.where("odds IS NOT NULL").where(goes_on(F.col("odds"))).select("doc")

    # near-copies among different texts; texts with equal words are one
    pairs = materialise(near_copies(measured.select("doc", "words", "shingles")), "pairs")
    ended = pairs.where("a_short >= 3 AND coalesce(b_short, 0) < 3").select(F.col("a").alias("doc"))
    ended = ended.unionByName(pairs.where("b_short >= 3 AND coalesce(a_short, 0) < 3").select(F.col("b").alias("doc"))).distinct()

    evidence = (
        ended.withColumn("evidence", F.lit("1 copy"))
        .unionByName(open_end.withColumn("evidence", F.lit("2 closing")))
        .unionByName(at_limit.withColumn("evidence", F.lit("3 ceiling")))
        .groupBy("doc")
        .agg(F.min("evidence").alias("evidence"))
    )
    evidence = materialise(evidence, "evidence")
    # copies of cut texts: over near-copies that end together, then over equal words
    cut_words = words.join(evidence, "doc").select("words").distinct()
    reps = words.groupBy("words").agg(F.min("doc").alias("doc"))
    together = pairs.where("a_short < 3 AND b_short < 3").select("a", "b")
    together = together.unionByName(together.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cut_reps = reps.join(cut_words, "words").select(F.col("doc").alias("a"))
    beside = together.join(cut_reps, "a").select(F.col("b").alias("doc")).join(reps, "doc").select("words")
    equal = words.join(cut_words.unionByName(beside).distinct(), "words").select("doc", F.lit(True).alias("equal"))
    out = measured.select("doc", "source").join(evidence, "doc", "left").join(equal, "doc", "left")
    reason = F.coalesce(F.substring("evidence", 3, 10), F.when(F.col("equal"), "equal"))
    return out.select(F.col("doc").alias("doc_id"), F.nullif("source", F.lit("")).alias("source"), reason.isNotNull().alias("cut"), reason.alias("evidence"))


def cut_shares(documents: DataFrame, judged: DataFrame) -> DataFrame:
    """(source, n_documents, n_cut, cut_share): for each source (null included) the share of all its documents that are cut."""
    flags = judged.where("cut").select("doc_id", F.lit(1).alias("cut"))
    return (
        documents.select("doc_id", "source")
        .join(flags, "doc_id", "left")
        .groupBy("source")
        .agg(F.count("*").alias("n_documents"), F.count("cut").alias("n_cut"))
        .withColumn("cut_share", F.col("n_cut") / F.col("n_documents"))
    )
