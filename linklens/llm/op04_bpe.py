"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The most frequent words of the corpus are encoded once and compiled to a
minimal acyclic automaton: words share prefixes and suffixes, and the sum of the
numbers on a word's arcs is its place in a table of ids. One task compiles it;
the arrays, whose size has a bound, are one file that Spark hands to every executor
and tasks memory-map. Words outside the lexicon are merged exactly, so the lexicon
changes the speed and never the result.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm.common import materialise, query, table
from linklens.session import ensure_checkpoint_dir, ship_package

#: Most words in the lexicon and their longest; a bound on what is compiled and mapped, not on what is encoded.
LEXICON_WORDS, LEXICON_CHARS = 1 << 18, 64
#: Frequencies are compared by steps of so many to an octave, so that no more than 64 octaves of them exist.
STEPS = 16
#: Bytes of the compiled lexicon in one row.
PART_BYTES = 1 << 20
#: Characters encoded at once, and bytes of unseen words and their ids that a task remembers.
CHUNK_CHARS, KEPT_BYTES = 1 << 20, 1 << 24
#: Bytes from which a word is merged with a heap.
LONG_WORD = 256
#: How the byte-level tokenizer splits text (fixed value of the published format).
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The splits worth counting, as a Java pattern.
COUNTED = r"( ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+)"


def byte_symbols() -> dict[str, int]:
    """Symbol of each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokenizer:
    """Vocabulary and merges of a byte-level BPE tokenizer file (JSON)."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model, symbols = spec["model"], byte_symbols()
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()], default=-1) + 1
        tokens = [b""] * size
        for token, i in vocab.items():
            tokens[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode("utf-8")
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_ends = np.cumsum([0, *map(len, tokens)])
        self.byte_ids = [vocab[s] for s, _ in sorted(symbols.items(), key=lambda x: x[1])]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []  # by rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
                                      + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word by the merges, lowest rank first, leftmost first among equals."""
        ids, rank_of, merged = [self.byte_ids[b] for b in word], self.ranks.get, self.merged
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        none = len(merged)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            rank = min(ranks)
            if rank == none:
                break
            i = ranks.index(rank)
            ids[i:i + 2] = (merged[rank],)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges with a heap and linked neighbours, for words of any length."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            rank, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue  # merged meanwhile
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := (ids[left], ids[right])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p], left, p))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ``ids``, of which text i has those from offsets[i] to offsets[i + 1]; no UTF-8 becomes U+FFFD."""
        sizes = self.token_ends[ids + 1] - self.token_ends[ids]
        ends = np.cumsum(sizes)
        where = np.repeat(self.token_ends[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        data, cuts = self.token_bytes[where].tobytes(), np.r_[0, ends][offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]  # noqa: B905

    def split(self, text: str) -> list[str]:
        """Words of a text; a special token is one word of its own."""
        if self.splitter is None or not any(s in text for s in self.special):
            return SPLIT.findall(text)
        parts = self.splitter.split(text)
        return [w for p in parts for w in ([p] if p in self.special else SPLIT.findall(p))]


class Lexicon:
    """Minimal acyclic transducer from words (bytes) to id sequences, as flat arrays in one file.

    ``keys``: state * 256 + byte of every arc, ascending; ``targets``, ``skips``: where it leads and the number of
    accepted words that come before; ``final``: accepting states; ``starts``, ``ids``: ids of the n-th word.
    """

    FIELDS = (("keys", "<i8"), ("targets", "<i4"), ("skips", "<i4"), ("final", "<i1"), ("starts", "<i8"),
              ("ids", "<i4"))

    def __init__(self, arrays: dict[str, np.ndarray], longest: int) -> None:
        self.__dict__.update(arrays)
        self.longest = longest

    @classmethod
    def build(cls, words: Iterable[bytes], encode) -> Lexicon:
        """Compile distinct ``words``; states with equal continuations are one state."""
        words = sorted(set(words))
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []  # (accepts, ((byte, target), ...)), each after its targets
        path: list[tuple[bool, list]] = [(False, [])]

        def freeze(depth: int) -> None:
            while len(path) > depth:
                accepts, arcs = path.pop()
                signature = (accepts, tuple(arcs))
                state = register.get(signature)
                if state is None:
                    state = register[signature] = len(states)
                    states.append(signature)
                if path:
                    byte = path[-1][1][-1][0]
                    path[-1][1][-1] = (byte, state)

        last = b""
        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            freeze(common + 1)
            for byte in word[common:]:
                path[-1][1].append((byte, -1))
                path.append((False, []))
            path[-1] = (True, path[-1][1])
            last = word
        freeze(0)
        below = [0] * len(states)
        keys, targets, skips = [], [], []
        for state, (accepts, arcs) in enumerate(states):
            count = int(accepts)
            for byte, target in arcs:
                keys.append(state * 256 + byte)
                targets.append(target)
                skips.append(count)
                count += below[target]
            below[state] = count
        ids = [encode(w) for w in words]
        arrays = {"keys": keys, "targets": targets, "skips": skips, "final": [s[0] for s in states],
                  "starts": np.cumsum([0, *map(len, ids)]), "ids": list(chain.from_iterable(ids))}
        return cls({n: np.asarray(arrays[n], dtype=kind) for n, kind in cls.FIELDS}, max(map(len, words), default=0))

    def dump(self) -> bytes:
        """The file that :meth:`load` maps."""
        arrays = [getattr(self, name) for name, _ in self.FIELDS]
        return b"".join([np.asarray([self.longest, *map(len, arrays)], "<i8").tobytes(), *[a.tobytes() for a in arrays]])

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Memory-map a saved lexicon: tasks of one machine share its pages."""
        head = np.fromfile(path, "<i8", 1 + len(cls.FIELDS))
        data, at, arrays = np.memmap(path, np.uint8, "r"), head.nbytes, {}
        for (name, kind), n in zip(cls.FIELDS, head[1:].tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            arrays[name] = data[at:at + size].view(kind)
            at += size
        return cls(arrays, int(head[0]))

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the lexicon, -1 for others; all words walk the automaton together."""
        n = len(words)
        found = np.full(n, -1, np.int64)
        if not len(self.keys):
            return found
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts, text = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(words), np.uint8)
        alive = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        state = np.full(len(alive), len(self.final) - 1, np.int64)  # the root is frozen last
        place = np.zeros(len(alive), np.int64)
        for at in range(self.longest + 1):
            ends = lengths[alive] == at
            done = ends & (self.final[state] == 1)
            found[alive[done]] = place[done]
            alive, state, place = alive[~ends], state[~ends], place[~ends]
            if not len(alive):
                break
            wanted = state * 256 + text[starts[alive] + at]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[arc] == wanted
            alive, arc, place = alive[hit], arc[hit], place[hit]
            state, place = self.targets[arc].astype(np.int64), place + self.skips[arc]
        return found


class Encoder:
    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon) -> None:
        self.tokenizer, self.lexicon, self.unseen, self.kept = tokenizer, lexicon, {}, 0

    def _merged(self, word: str) -> bytes:
        """Ids of a word, four bytes each."""
        if word in self.tokenizer.special:
            return np.int32(self.tokenizer.special[word]).tobytes()
        ids = self.unseen.get(word)
        if ids is None:
            ids = np.array(self.tokenizer.merge(word.encode("utf-8")), np.int32).tobytes()
            size = 4 * len(word) + len(ids)
            if self.kept + size > KEPT_BYTES:
                self.unseen.clear()
                self.kept = 0
            if size <= KEPT_BYTES:
                self.unseen[word] = ids
                self.kept += size
        return ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        split = [self.tokenizer.split(t) for t in texts]
        distinct: defaultdict[str, int] = defaultdict()
        distinct.default_factory = distinct.__len__  # a new word gets the next number
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter(map(distinct.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        lexicon = self.lexicon
        place = lexicon.find([w.encode("utf-8") for w in distinct])
        for s in self.tokenizer.special:
            if s in distinct:
                place[distinct[s]] = -1
        other = [self._merged(w) for w, p in zip(distinct, place.tolist(), strict=True) if p < 0]
        known = np.maximum(place, 0)
        first = np.empty(len(distinct), np.int64)
        length = np.empty(len(distinct), np.int64)
        seen, rest = place >= 0, place < 0
        if seen.any():
            first[seen] = lexicon.starts[known[seen]]
            length[seen] = lexicon.starts[known[seen] + 1] - first[seen]
        length[rest] = [len(x) // 4 for x in other]
        first[rest] = np.cumsum(length[rest]) - length[rest]
        runs = length[codes]
        ends = np.cumsum(runs)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(first[codes] - (ends - runs), runs) + np.arange(total)
        mapped, ids = np.repeat(seen[codes], runs), np.empty(total, np.int32)
        ids[mapped] = lexicon.ids[place[mapped]]  # from the mapped file, without a copy of it
        ids[~mapped] = np.frombuffer(b"".join(other), np.int32)[place[~mapped]]
        return ids, np.r_[0, np.r_[0, ends][np.cumsum(sizes)]]


def frequent_words(docs: DataFrame, text_col: str, limit: int) -> DataFrame:
    """(word) of the most frequent words of all texts, at most ``limit``, none that occurs once.

    Words are counted whole. Counts that fall in one step (a sixteenth of an octave)
    go in or stay out together: the driver gets one row for each step, at most 64 * STEPS
    of them, and the words themselves stay with the executors.
    """
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(COUNTED), F.lit(1))
    words = docs.select(F.explode_outer(found).alias("word"))  # explode would search twice, for a filter on the size
    counts = materialise(
        words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n"))
        .filter((F.col("n") > 1) & (F.length("word") <= LEXICON_CHARS))
        .select("word", F.floor(F.log2("n") * STEPS).cast("int").alias("step")), "words")
    room, least = limit, 64 * STEPS
    for step, n in counts.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if n > room:
            break
        room, least = room - n, step
    return counts.filter(F.col("step") >= least).select("word")


def compile_lexicon(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
                    limit: int = LEXICON_WORDS) -> tuple[str, str]:
    """Compile the corpus' lexicon; (lexicon, tokenizer): names by which executors get the two files from Spark.

    One task compiles the words, of which there are at most ``limit``; the driver gets the finished arrays and
    hands them out. Null texts have no words; an empty table gives an empty lexicon.
    Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    tag = uuid.uuid4().hex[:12]
    names = f"lexicon-{tag}.bin", f"tokenizer-{tag}.json"
    with open(tokenizer_path, encoding="utf-8") as source:
        text = source.read()
    folder = tempfile.mkdtemp(prefix="linklens-bpe-")  # the driver's own; Spark copies its files to the executors
    with open(os.path.join(folder, names[1]), "w", encoding="utf-8") as out:
        out.write(text)
    spark.sparkContext.addFile(os.path.join(folder, names[1]))

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(SparkFiles.get(names[1]), encoding="utf-8") as source:
            tokenizer = Tokenizer(source.read())
        words = (w.encode("utf-8") for batch in batches for w in batch.column(0).to_pylist() if w not in tokenizer.special)
        data = Lexicon.build(words, tokenizer.merge).dump()
        for part, at in enumerate(range(0, len(data), PART_BYTES)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data[at:at + PART_BYTES]], pa.binary())],
                                             names=["part", "data"])

    parts = frequent_words(docs, text_col, limit).repartition(1).mapInArrow(compiled, "part int, data binary")
    data = b"".join(row["data"] for row in sorted(parts.collect()))  # some 10 MB for the most words there can be
    with open(os.path.join(folder, names[0]), "wb") as out:
        out.write(data or Lexicon.build([], list).dump())
    spark.sparkContext.addFile(os.path.join(folder, names[0]))
    return names


_LOADED: dict[tuple[str, str], tuple[Tokenizer, Lexicon]] = {}


def load_files(names: tuple[str, str]) -> tuple[Tokenizer, Lexicon]:
    """The tokenizer and mapped lexicon in this worker, loaded once."""
    if names not in _LOADED:
        _LOADED.clear()
        with open(SparkFiles.get(names[1]), encoding="utf-8") as source:
            _LOADED[names] = Tokenizer(source.read()), Lexicon.load(SparkFiles.get(names[0]))
    return _LOADED[names]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``CHUNK_CHARS`` characters (one text is never cut)."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, names: tuple[str, str], id_col: str = "doc_id",
                     text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id, ids array<int>) of every row; null and empty texts have no ids; repeated rows each get theirs.

    With ``decode`` also text, decoded from the ids just made in the same pass.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, lexicon = load_files(names)
        encoder = Encoder(tokenizer, lexicon)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _chunks(texts):
                ids, offsets = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                columns = [batch.column(0).slice(a, b - a), lists]
                if decode:
                    columns.append(pa.array(tokenizer.decode(ids, offsets), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "text"][:len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    out = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
           .mapInArrow(encode, f"id {kind}, ids array<int>" + ", text string" * decode))
    return out.toDF(id_col, "ids", "text") if decode else out.toDF(id_col, "ids")


def decode_documents(encoded: DataFrame, names: tuple[str, str], id_col: str = "doc_id",
                     ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) of every row; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_files(names)[0]
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = tokenizer.decode(lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], names=["id", "ids", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return (encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
            .mapInArrow(decode, f"id {kind}, ids array<int>, text string")
            .toDF(id_col, ids_col, "text"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded_and_decoded(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of every row of ``docs``, through ids and back."""
    names = compile_lexicon(docs, tokenizer_path or default_tokenizer())
    return encode_documents(docs, names, decode=True)


@query("op4_bpe")
def op4_bpe(spark, sf_dir):
    out = encoded_and_decoded(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
                      .alias("ids_sha256"),
                      F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
