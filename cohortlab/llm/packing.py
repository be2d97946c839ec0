"""Best-fit packing by minimum bin slack.

Texts are tokenized and cut into pieces of at most ``limit`` tokens. Packing needs the
pieces' lengths alone: their histogram has at most ``limit`` rows at any corpus size. For
each bin the longest length left is set, a bitset subset-sum over the other lengths finds
the fullest combination, and it is removed as often as the counts allow; the length that
stops it is at least halved, so there are at most limit x log2(rows) combinations. Each
combination becomes a few rows (length, ranks, sequence, offset), a table bounded by the
limit and not by the corpus, and pieces find their place by their rank within their length.

Defined cases: a null text is empty and gives one piece, the end token; equal rows each get
their pieces; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .caches import enter
from .chunks import texts_of
from .stage import distributed_rank, ship, stage

LIMIT = 4096
END = 1
CACHED_WORDS = 800_000
LONGEST_CACHED = 48  # bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordTokenizer:
    """Little-endian 32-bit ids of whole texts. The tokenizer never joins across ASCII white
    space, so texts are cut there and each word's ids are kept for the next time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known: dict[bytes, bytes] = {}
        self.mark, = self.model.encode(SEPARATOR.decode(), add_special_tokens=False).ids
        self.letters = None
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        if suffix:  # words of small letters alone need no normalizing, and are parted where the suffix stands
            self.letters = Tokenizer.from_file(path)
            self.letters.encode_special_tokens = True
            self.letters.normalizer = None
            self.letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            names = self.model.get_vocab()
            self.ends = np.zeros(max(names.values()) + 1, bool)
            self.ends[[i for t, i in names.items() if t.endswith(suffix)]] = True

    def _encode(self, new: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words joined by a mark of their own, whose id parts their ids again. A word that
        holds the mark's byte goes alone."""
        alone = [w for w in new if SEPARATOR in w]
        for w in alone:
            yield w, np.array(self.model.encode(w.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()
        new = [w for w in new if SEPARATOR not in w] if alone else new
        glue = b" " + SEPARATOR + b" "
        yield from self._parted(new, self.model, lambda words: glue.join(words) + glue, lambda ids: ids == self.mark, 1)

    def _parted(self, new: list[bytes], model, join, ends, marks: int) -> Iterator[tuple[bytes, bytes]]:
        """Each word's ids, encoded JOINED words a text. ``ends`` tells the ids that words end
        at, the last ``marks`` of which are not theirs."""
        parts = [new[at:at + JOINED] for at in range(0, len(new), JOINED)]
        for at in range(0, len(parts), 64):
            some = parts[at:at + 64]
            done = model.encode_batch_fast([join(p).decode("utf-8") for p in some], add_special_tokens=False)
            for words, e in zip(some, done):
                ids = np.array(e.ids, "<u4")
                data, stop = ids.tobytes(), 4 * (np.flatnonzero(ends(ids)) + 1)
                if len(stop) != len(words):
                    raise ValueError(f"{len(words)} words came back as {len(stop)}")
                for w, start, end in zip(words, [0, *stop.tolist()], (stop - 4 * marks).tolist()):
                    yield w, data[start:end]

    def _learn(self, words: set[bytes]) -> None:
        """A word that ends in a run of marks after a letter or digit is its stem's ids and the run's."""
        known, new, ended, stems, runs = self.known, set(), [], [], []
        for w in words:
            if w[-1] in MARKS:
                stem = w.rstrip(MARKS)
                if stem and (stem[-1] in ALNUM or _ends_in_letter(stem)):
                    run = w[len(stem):]
                    ended.append(w)
                    stems.append(stem)
                    runs.append(run)
                    if stem not in known:
                        new.add(stem)
                    if run not in known:
                        new.add(run)
                    continue
            new.add(w)
        if self.letters is not None:
            plain = list(filter(SMALL_LETTERS, new))
            known.update(self._parted(plain, self.letters, b" ".join, self.ends.__getitem__, 0))
            new = filterfalse(SMALL_LETTERS, new)
        known.update(self._encode(list(new)))
        get = known.__getitem__
        known.update(zip(ended, map(add, map(get, stems), map(get, runs))))

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        split = [_folded(t).split() for t in texts]
        found = [list(map(self.known.get, words)) for words in split]
        lacking = [[k for k, i in enumerate(ids) if i is None] for ids in found]
        fresh = {words[k] for words, at in zip(split, lacking) for k in at}
        if len(self.known) + 2 * len(fresh) > CACHED_WORDS:
            self.known.clear()  # ``found`` holds what these texts need of it
        self._learn(fresh)
        get = self.known.__getitem__
        for words, ids, at in zip(split, found, lacking):
            for k in at:
                ids[k] = get(words[k])
            yield b"".join(ids)
        for w in [w for w in fresh if len(w) > LONGEST_CACHED]:
            del self.known[w]


MARKS = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
ALNUM = bytes(c for c in range(128) if chr(c).isalnum())
SEPARATOR = b"\x01"
JOINED = 256  # words a text
#: Letters that NFC and lower-casing leave as they are: a to z, and of Latin-1 \u00df to \u00f6, \u00f8 to \u00ff.
SMALL_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def _ends_in_letter(word: bytes) -> bool:
    """Whether the last character is a Latin letter beyond ASCII (two bytes, up to U+024F) and
    stays one in small: that of U+0130 ends in a combining mark, which takes the marks after it."""
    return word[-1] >= 0x80 and b"\xc3" <= word[-2:-1] <= b"\xc9" and word[-2:].decode("utf-8").lower().isalpha()


_TOKENIZERS: dict[str, WordTokenizer] = {}  # one a worker process, kept from task to task


def _folded(text: bytes) -> bytes:
    """ASCII letters lower-cased, as the tokenizer does; a text with combining marks
    (U+0300 to U+036F) stays, as those join upper and lower case differently."""
    return text if b"\xcc" in text or b"\xcd" in text else text.lower()


def shared_tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenize(docs: DataFrame, path: str, limit: int = LIMIT, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, ids (little-endian 32-bit, or null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enter("packing", _TOKENIZERS.clear)
        model = shared_tokenizer(path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch)
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= 1 << 21):
                    size, stop = size + len(texts[stop]), stop + 1
                rows = []
                for i, data in zip(ids[at:stop], model.encode(texts[at:stop])):
                    data += end
                    for k in range(0, len(data), 4 * limit):
                        part = data[k:k + 4 * limit]
                        rows.append((i, k // (4 * limit), k // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
                at = stop
    ship(docs.sparkSession)
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cols.mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    best, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + take
            best -= length * take
    return used


def minimum_bin_slack(counts: dict[int, int], limit: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how many}) for all bins."""
    left, out = {x: n for x, n in counts.items() if n > 0}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        if not left[longest]:
            del left[longest]
        used = fullest(left, limit - longest) if limit > longest else {}
        left[longest] = left.get(longest, 0) + 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((times, used))
    return out


def places(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, pieces a sequence, first sequence, first offset)."""
    used, sequence, out = {}, 0, []
    for times, combination in plan:
        offset = 0
        for length, n in sorted(combination.items(), reverse=True):
            first = used.get(length, 0)
            used[length] = first + n * times
            out.append((length, first, used[length], n, sequence, offset))
            offset += n * length
        sequence += times
    return out


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``. ``pieces`` should be a stage table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``limit`` rows
    table = spark.createDataFrame(places(minimum_bin_slack(counts, limit)) or [],
                                  "_len long, _from long, _to long, _each long, _seq long, _off long")
    buckets = max(1, min(4096, sum(counts.values()) // 4096))
    ranked = distributed_rank(pieces, ["length"], ["doc_id", "piece"], F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)), buckets, "_rank")
    at = F.col("_rank") - F.col("_from")
    return ranked.join(F.broadcast(table), (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))) \
        .withColumns({"sequence_id": F.col("_seq") + F.floor(at / F.col("_each")).cast("long"),
                      "offset": F.col("_off") + (at % F.col("_each")) * F.col("length")}) \
        .drop("_rank", "_len", "_from", "_to", "_each", "_seq", "_off")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, at most ``limit`` of them."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")) \
        .select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str | None = None, limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    pieces = stage(tokenize(docs, path or tokenizer_path(), limit, keep_ids), "pieces")
    return pack(pieces, limit)
