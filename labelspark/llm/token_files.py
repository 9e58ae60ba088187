"""Token ids as flat binary files that can be memory-mapped.

Per sorted partition there are three files in the shared folder:

* ``.bin``  the token ids of all its documents, one after the other (unsigned, 16 bits where the vocabulary allows, else 32);
* ``.idx``  64-bit offsets in tokens: where each document starts, and the end of the last one;
* ``.doc``  64-bit document ids (``NO_ID`` for a null id).

A file's first token has a global position too: the prefix sum of the token counts of the partitions before it, kept in the
manifest.  Documents are range-sorted by id, so partitions and files are in ascending order (null ids first).
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from labelspark.llm import wordhash
from labelspark.llm.storage import shared_folder, write_table

NO_ID = -(1 << 63)
CACHED_WORDS = 1_000_000  # per Python worker
TOGETHER = 250  # words of letters encoded in one string
ENDINGS = frozenset(".,")
LONGEST_CACHED = 64  # characters
READ_TOKENS = 1 << 20  # tokens looked at together when files are read back


def word_cache(path: str) -> dict[str, bytes]:
    """Words already encoded by this worker process; it outlives a task, as workers do."""
    store = sys.modules.setdefault("_labelspark_words", types.ModuleType("_labelspark_words"))
    return store.__dict__.setdefault(path, {})


class Encoder:
    """Encodes texts as the tokenizer does, word by word.

    The tokenizer's first step drops white space and never joins across it, so the ids of a text are those of its parts
    between spaces and line feeds, one after the other.  Parts repeat, and each new one is encoded once: words of letters
    many at a time, told apart by the tokens that end a word; all others by themselves.  Written for tokenizers that lower
    their texts, split signs off words, and mark word ends, which is checked.
    """

    def __init__(self, path: str, width: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.cache, self.width = Tokenizer.from_file(path), f"<u{width}", word_cache(f"{path}:{width}"), width
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        probe = self.tokenizer.encode("Ab, cd.", add_special_tokens=False).ids
        if not suffix or probe != [i for w in ("ab", ",", "cd", ".") for i in self.tokenizer.encode(w, add_special_tokens=False).ids]:
            raise ValueError("this tokenizer does not lower its texts, split signs off, and mark word ends")
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _encoded(self, words: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in encoded]

    def _stems(self, stems: list[str]) -> dict[str, bytes]:
        """Ids of words of letters: one word end each."""
        known = {}
        runs = [stems[i:i + TOGETHER] for i in range(0, len(stems), TOGETHER)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(stops) == len(run):
                raw = ids.tobytes()
                known.update(zip(run, [raw[s:t] for s, t in zip([0, *stops], stops, strict=False)], strict=True))
            else:  # a tokenizer that ends words otherwise
                known.update(zip(run, self._encoded(run), strict=True))
        return known

    def _learn(self, new: set[str]) -> set[str]:
        """Encode words that are not known yet; returns what was added."""
        stems, other = {}, [w for w in ENDINGS if w not in self.cache]
        for w in new:
            tail = w[-1:] if w[-1:] in ENDINGS else ""
            stem = w[:-1] if tail else w
            if stem.isalpha() and (stem.isascii() or (is_normalized("NFC", stem) and stem.lower().isalpha())):
                stems[w] = (stem.lower() if stem.isascii() else stem, tail)
            elif w not in ENDINGS:
                other.append(w)
        fresh = dict(zip(other, self._encoded(other), strict=True))
        unknown = list({stem for stem, _ in stems.values()}.difference(self.cache))
        fresh.update(self._stems(unknown))
        self.cache.update(fresh)
        # The tokenizer splits signs off words, and reads capitals as small letters.
        self.cache.update({w: self.cache[stem] + (self.cache[tail] if tail else b"") for w, (stem, tail) in stems.items()})
        return fresh.keys() | stems.keys()

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        added = self._learn(set(chain.from_iterable(parts)).difference(self.cache))
        out = [b"".join(map(self.cache.__getitem__, p)) for p in parts]
        for w in added:
            if len(w) > LONGEST_CACHED:
                del self.cache[w]
        return out


def id_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes of an id on disk."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4


def _writer(folder: str, tokenizer_path: str, end_id: int, width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(tokenizer_path, width), np.array([end_id], f"<u{width}").tobytes()
        store, root = pa.fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        base, mine = f"{root}/part-{part:06d}", f"{root}/_attempt-{attempt}"
        offsets, ids, written = [np.zeros(1, np.int64)], [], 0
        with store.open_output_stream(f"{mine}.bin") as out:
            for batch in batches:
                data, bounds = wordhash.utf8(batch.column(1))
                for low, high in wordhash.slices(bounds):
                    texts = [data[s:e].tobytes().decode() for s, e in zip(bounds[low:high], bounds[low + 1:high + 1], strict=True)]
                    coded = [c + end for c in encode(texts)]
                    sizes = np.cumsum([len(c) // width for c in coded])
                    offsets.append(sizes + written)
                    written += int(sizes[-1])
                    out.write(b"".join(coded))
                ids.append(np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], "<i8"))
        offsets = np.concatenate(offsets).astype("<i8")
        for suffix, values in (("idx", offsets), ("doc", np.concatenate(ids) if ids else np.zeros(0, "<i8"))):
            with store.open_output_stream(f"{mine}.{suffix}") as out:
                out.write(values.tobytes())
        for suffix in ("bin", "idx", "doc"):  # whole files appear at once; a repeated task puts the same bytes there
            store.move(f"{mine}.{suffix}", f"{base}.{suffix}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/part-{part:06d}"]),
                                          pa.array([len(offsets) - 1], pa.int64()), pa.array([written], pa.int64())],
                                         names=["part", "file", "n_docs", "n_tokens"])
    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode all texts and write the files; returns the manifest: part, file, n_docs, n_tokens, base.

    A null text is empty: it gets the end id alone.  Rows of one id stay next to each other in the order of a hash of their
    text; repeated rows are written each time.  Without documents the manifest holds no tokens.
    """
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    store, root = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    store.create_dir(root)
    folder = folder if "://" in folder else f"file://{folder}"
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    run = _writer(folder, tokenizer_path, end_id, id_width(tokenizer_path, end_id))
    parts = write_table(rows.mapInArrow(run, "part int, file string, n_docs long, n_tokens long"), "token_parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _mapped(file: str, suffix: str, kind: str) -> np.ndarray:
    """A file as an array: memory-mapped where it lies on a mounted disk, else read."""
    store, path = pa.fs.FileSystem.from_uri(f"{file}.{suffix}")
    if not store.get_file_info(path).size:
        return np.zeros(0, kind)
    if isinstance(store, pa.fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype=kind)


def _reader(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                offsets, ids = _mapped(row["file"], "idx", "<i8"), _mapped(row["file"], "doc", "<i8")
                tokens = _mapped(row["file"], "bin", f"<u{width}")
                low = 0
                while low < len(ids):
                    high = int(np.searchsorted(offsets, offsets[low] + READ_TOKENS, side="right")) - 1
                    high = min(max(high, low + 1), len(ids))
                    block = tokens[offsets[low]:offsets[high]].astype("<u4")
                    ends = offsets[low:high + 1] - offsets[low]
                    sums = [zlib.crc32(block[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
                    own = np.asarray(ids[low:high])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own, pa.int64(), mask=own == NO_ID), pa.array(offsets[low:high] + row["base"]),
                         pa.array(np.diff(ends)), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    low = high
    return run


def read_token_files(manifest: DataFrame, width: int) -> DataFrame:
    """One row per document, read from the files: doc_id, start (global position), n_tokens, ids_crc32.

    The checksum is that of the ids as little-endian unsigned 32-bit integers.  One task reads one file or a few.
    """
    files = manifest.where("n_docs > 0").select("file", "base", "part")
    n = max(files.count(), 1)
    return files.repartition(n, "part").mapInArrow(_reader(width), "doc_id long, start long, n_tokens long, ids_crc32 long")
