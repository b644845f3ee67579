"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Every document is streamed word by word through one automaton that holds all substrings of all items, so the
longest suffix of the words read so far that occurs in an item is known at each word at amortised constant cost.
Where that length reaches the window, the window's words are hit, and the state names the items that contain it.
No shuffle: the automaton of a bounded block of items is broadcast; a larger test set is taken in blocks, one pass
over the documents for each, and the passes' hits are united.

Defined results: a null or empty text has no words and no hits; an item with no words never matches; an item without
an id hits words like any other, but no list of items names it; repeated items each count; repeated documents are separate rows; input columns named like an output are replaced; an empty test set
leaves all documents clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanrisk.llm.common import release, staged, with_text_columns

#: A word is a run of ASCII letters, digits and non-ASCII characters; A-Z is lower-cased.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()

WINDOW = 10
#: Item words in one automaton, and so the bound of one broadcast (some 50 MB of Python objects).
BLOCK_WORDS = 100_000

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS),
          T.StructField("items", T.ArrayType(T.LongType()))]


def words(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """Automaton of all substrings of several word sequences."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, w: bytes) -> int:
        """State for the strings of length up to ``length[p] + 1`` that end with ``w`` after ``p``."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[bytes]) -> None:
        last = 0
        for w in sequence:
            if w in self.next[last]:
                last = self._split(last, w)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, w)
            last = new

    def finish(self, sequences: list[tuple[int, list[bytes], bool]]) -> None:
        """Note at each state which items' windows end there. ``sequences``: item id, words, whole item or a piece."""
        n = len(self.length)
        self.items: list[set[int] | None] = [None] * n  # of windows of the full length
        whole: dict[int, tuple[int, set[int]]] = {}  # of items shorter than a window
        self.at = [-1] * n  # the state that holds the window-long suffix
        for v in sorted(range(1, n), key=self.length.__getitem__):
            if self.length[v] >= self.window:
                up = self.link[v]
                self.at[v] = self.at[up] if self.length[up] >= self.window else v
        for item, seq, _ in sequences:
            v = 0
            for i, w in enumerate(seq, 1):
                v = self.next[v][w]
                if i >= self.window:
                    k = self.at[v]
                    if self.items[k] is None:
                        self.items[k] = set()
                    self.items[k].add(item)
            if 0 < len(seq) < self.window:
                whole.setdefault(v, (len(seq), set()))[1].add(item)
        self.short: list[tuple] = [()] * n  # (length, items) of whole short items that are suffixes, longest first
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.short[self.link[v]]
            self.short[v] = ((whole[v][0], frozenset(whole[v][1])), *up) if v in whole else up

    def scan(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal runs of hit words as [start, end), and the items with a window in ``doc``."""
        nxt, link, length, at, items, short, window = (
            self.next, self.link, self.length, self.at, self.items, self.short, self.window)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        v = size = 0
        for i, w in enumerate(doc, 1):
            to = nxt[v].get(w)
            if to is None:
                while v and to is None:
                    v = link[v]
                    to = nxt[v].get(w)
                if to is None:
                    size = 0
                    continue
                size = length[v]
            v = to
            size += 1
            reach = 0
            if size >= window:
                found |= items[at[v]]
                reach = window
            if short[v]:
                for k, whose in short[v]:
                    if k <= size:
                        found |= whose
                        reach = max(reach, k)
            if reach:
                start = i - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, found


def build(sequences: list[tuple[int, list[bytes], bool]], window: int) -> SuffixAutomaton:
    automaton = SuffixAutomaton(window)
    for _, seq, _ in sequences:
        automaton.add(seq)
    automaton.finish(sequences)
    return automaton


def _blocks(items: DataFrame, window: int, limit: int) -> Iterator[list[tuple[int, list[bytes], bool]]]:
    """Item words in blocks of at most ``limit``. A longer item is cut into pieces that overlap by a window less one
    word, so no window is lost. Rows come to the driver one partition at a time, one block is held."""
    block, held = [], 0
    for item, text in items.toLocalIterator():
        seq = words((text or "").encode("utf-8", "surrogatepass"))
        step = max(1, limit - window + 1)
        pieces = [seq] if len(seq) <= limit else [seq[i:i + limit] for i in range(0, len(seq) - window + 1, step)]
        for piece in pieces:
            if not piece:
                continue
            if block and held + len(piece) > limit:
                yield block
                block, held = [], 0
            block.append((item, piece, len(pieces) == 1))
            held += len(piece)
    if block:
        yield block


def find_overlaps(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, hit_spans (maximal runs of hit words, [start, end) by word index) and items (sorted ids
    of items with a window in the text). ``items``: (item_id, text)."""
    spark = docs.sparkSession
    out, paths = docs, []
    blocks = _blocks(items, window, block_words)
    block = next(blocks, [])
    first = True
    while first or block:
        after = next(blocks, [])
        held = spark.sparkContext.broadcast(build(block, window))
        out = with_text_columns(out, text, FIELDS if first else
                                [T.StructField(f"{f.name}__more", f.dataType) for f in FIELDS],
                                _scanner(held, "" if first else "__more"))
        if not first:
            out = _united(out, text)
        if after:
            out, path = staged(out, "overlaps")
            release(spark, *paths)
            paths = [path]
        first, block = False, after
    return out


def _scanner(held, suffix: str):
    def make():
        automaton = held.value

        def step(texts: list[bytes]) -> dict[str, object]:
            out: dict[str, list] = {f.name + suffix: [] for f in FIELDS}
            for t in texts:
                doc = words(t)
                spans, found = automaton.scan(doc)
                out["n_words" + suffix].append(len(doc))
                out["hit_spans" + suffix].append([{"start": s, "end": e} for s, e in spans])
                out["items" + suffix].append(sorted(x for x in found if x is not None))
            return out

        return step

    return make


def _united(df: DataFrame, text: str) -> DataFrame:
    """Hits of two passes as one: runs that touch or overlap are joined."""
    ordered = F.array_sort(F.concat("hit_spans", "hit_spans__more"))
    joined = F.aggregate(
        ordered, F.array().cast(SPANS),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"),
                             F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
    return (df.withColumn("hit_spans", joined)
            .withColumn("items", F.array_sort(F.array_union("items", "items__more")))
            .drop("n_words__more", "hit_spans__more", "items__more"))


def n_hit(spans: Column | str = "hit_spans") -> Column:
    """Number of hit words."""
    return F.aggregate(F.col(spans) if isinstance(spans, str) else spans, F.lit(0).cast("bigint"),
                       lambda acc, s: acc + s["end"] - s["start"])


def cut(text: str | None, spans: list) -> str | None:
    """``text`` without the words of ``spans`` and what stands between them."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.lower())]  # of bytes: A-Z only, and no byte moves
    kept, pos = [], 0
    for s in spans:
        kept.append(raw[pos:at[s["start"]][0]])
        pos = at[s["end"] - 1][1]
    return b"".join([*kept, raw[pos:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW,
                  min_span: int = 1, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Remove hit runs of at least ``min_span`` words from every text, and every document of which more than
    ``max_coverage`` of the words are hit. Clean texts stay as they are. Output: the input's columns."""
    marked = find_overlaps(docs, items, text, window, block_words)
    marked = marked.filter(n_hit() <= max_coverage * F.col("n_words"))
    at = marked.columns.index(text)

    def rewrite(batches):
        import pyarrow as pa

        for batch in batches:
            spans, whole = batch.column("hit_spans").to_pylist(), batch.column(text).to_pylist()
            new = [cut(t, [s for s in ss if s["end"] - s["start"] >= min_span]) for t, ss in zip(whole, spans)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return marked.mapInArrow(rewrite, marked.schema).drop("n_words", "hit_spans", "items")


def item_digest(items: Column | str = "items") -> Column:
    """SHA-256 of the item ids, sorted as strings, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)
