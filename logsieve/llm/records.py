"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A data file is a sequence of frames: length of the payload (8 bytes), masked checksum of those 8
bytes (4), payload, masked checksum of the payload (4), all little-endian. A payload is doc_id (8,
signed), bytes per id (1: 2 or 4), and the ids. The index beside it holds for each record the
doc_id (8), the frame's offset (8) and the number of ids (8), so any record can be read alone.
Files are ranges of doc_id; the manifest lists them in that order with the ids before each.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsieve.llm.batches import small_batches
from logsieve.llm.files import attempt_name, new_folder, open_folder
from logsieve.sources.sinks import stage

#: Distinct words, and other pieces, whose ids a worker remembers (some 100 bytes each), and characters
#: of one call to the tokenizer.
WORDS = 1_000_000
REMEMBERED, CALL_CHARS = 300_000, 20_000
#: Characters whose words are looked up together.
GATHERED = 6_000_000
#: A word and signs behind it, none of them an apostrophe.
SIGNS = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[.,;:!?%&*#$|()]+)$"
SIGNED = re.compile(SIGNS).match
#: Nothing, or white space at the end.
WHITE_END = r"(?:^|[\s\x0b\x1c-\x1f\x85\p{Z}])\z"
ANY_WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: Where a text is cut: before a blank behind something other than white space.
BEHIND_TEXT = re.compile(r"(?<=\S)(?= )")
NO_IDS = np.empty(0, "<u4")
MASK = 0xA282EAD8
HEAD, PAYLOAD, ENTRY = "<QI", "<qB", "<qQQ"


def masked(data: bytes) -> int:
    """A CRC-32, rotated and shifted so that a checksum of data holding checksums stays useful."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


class CorruptRecord(ValueError):
    """A frame whose length or payload does not match its checksum."""


class Tokens:
    """Encodes texts with a tokenizer file, piece by piece.

    A text is cut before every blank that follows something other than white space. The byte-level
    split pattern cuts there in every text, so the ids of the pieces are the ids of the text, and
    the tokenizer only sees pieces that this worker has not met lately. That holds for this pattern
    without a normaliser; other tokenizer files are refused.
    """

    def __init__(self, tokenizer: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        stated = json.loads(tokenizer)
        split = stated.get("pre_tokenizer") or {}
        if stated.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level tokenizers with the usual split pattern and no normaliser")

        self.tokenizer = Tokenizer.from_str(tokenizer)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            # The library's own memory of words only costs time where each word comes once.
            self.tokenizer.model._resize_cache(0)
        #: Words without white space, each behind a blank: its row, the rows' lengths and all their ids.
        self.row: dict[str, int] = {}
        self.lengths, self.flat = np.empty(0, np.int64), NO_IDS
        #: Packed ids of a blank and this text; only texts that do not end in white space. When
        #: full it becomes ``older``, which gives back what is met again.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: The same for texts without a blank.
        self.bare: dict[str, bytes] = {}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, parts: set[str]) -> None:
        """Learns texts behind a blank from what they are made of: a word, signs behind it and
        lines behind a line feed are matches of their own and come back with others."""
        made = []
        words, bare = set(), set()
        for part in parts:
            first, *lines = part.split("\n")
            if not part or part[-1].isspace() or lines and not all(x and not x[0].isspace() and not x[-1].isspace() for x in (first, *lines)):
                words.add(part)
                continue
            word, signs = found.groups() if (found := SIGNED(first)) else (first, "")
            words.add(word)
            bare.update(lines, [signs] if signs else [])
            if word != part:
                made.append((part, word, signs, lines))
        if len(self.bare) > REMEMBERED:
            self.bare.clear()
        self._encode_all(self._unknown(words), self.known, " ")
        self._encode_all(bare.difference(self.bare), self.bare, "")
        feed = self._plain("\n").tobytes()
        for part, word, signs, lines in made:
            packed = self.known[word] + (self.bare[signs] if signs else b"")
            self.known[part] = packed + b"".join([feed + self.bare[line] for line in lines])

    def _unknown(self, parts: set[str]) -> set[str]:
        """Those of ``parts`` that neither generation knows; the older one's come over."""
        missing = parts.difference(self.known)
        again = {p for p in missing if p in self.older}
        self.known.update((p, self.older[p]) for p in again)
        return missing - again

    def _encode_all(self, texts: set[str], store: dict[str, bytes], blank: str) -> None:
        """Many texts go through one call, with line feeds between them: a line feed before
        something else than white space, or before one blank, is an id of its own."""
        single, plain = [], []
        for text in texts:
            usual = self.feed is not None and text and "\n" not in text and not text[0].isspace() and not text[-1].isspace()
            (plain if usual else single).append(text)
        at = 0
        while at < len(plain):
            end, size = at, 0
            while end < len(plain) and size < CALL_CHARS:
                size += len(plain[end]) + 2
                end += 1
            some = plain[at:end]
            ids = self._plain("".join([f"\n{blank}{text}" for text in some]) + "\n")
            cuts = np.flatnonzero(ids == self.feed).tolist()
            if len(cuts) != len(some) + 1:
                single += some
            else:
                packed = ids.tobytes()
                for text, low, high in zip(some, cuts, cuts[1:]):
                    store[text] = packed[4 * low + 4 : 4 * high]
            at = end
        for text in single:
            store[text] = self._plain(blank + text).tobytes()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. The texts are cut at blanks in one step and their distinct pieces
        looked up; the ids of all texts are then gathered by the pieces' numbers."""
        out: list[np.ndarray | None] = [NO_IDS if not t else None for t in texts]
        special = [any(s in t for s in self.specials) for t in texts]
        rows = [i for i, t in enumerate(texts) if t]
        lists = pc.split_pattern(pa.array([texts[i] for i in rows], pa.large_string()), " ")
        pieces = lists.flatten().dictionary_encode()
        codes, starts = pieces.indices.to_numpy(), lists.offsets.to_numpy()
        # A blank after white space, or at the start, stays with what stands before it.
        ends_white = pc.match_substring_regex(pieces.dictionary, WHITE_END).to_numpy(zero_copy_only=False)
        uneven = np.logical_or.reduceat(ends_white[codes], starts[:-1]) if rows else ends_white
        for i, bad in zip(rows, uneven):
            if special[i]:
                out[i] = self._plain(texts[i])
            elif bad:
                out[i] = self._uneven(texts[i])
        even = np.array([out[i] is None for i in rows], bool)
        sizes, first = np.diff(starts), starts[:-1][even]
        mine = np.repeat(even, sizes)
        heads = np.zeros(len(codes), bool)
        heads[starts[:-1]] = True
        # A word and the signs behind it are matches of their own: both are looked up apart.
        split = pc.extract_regex(pieces.dictionary, SIGNS)
        words = pc.if_else(pc.is_valid(split), pc.struct_field(split, "word"), pieces.dictionary).dictionary_encode()
        signs = pc.fill_null(pc.struct_field(split, "signs"), "").dictionary_encode()
        word, sign = words.indices.to_numpy()[codes], signs.indices.to_numpy()[codes]
        used = np.unique(word[mine & ~heads])
        used_words = words.dictionary.take(pa.array(used))
        spaced = pc.match_substring_regex(used_words, ANY_WHITE).to_numpy(zero_copy_only=False)
        usual = self._rows_of(used_words.filter(pa.array(~spaced)).to_pylist())
        others = used_words.filter(pa.array(spaced)).to_pylist()
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        self._learn(self._unknown(set(others)))
        packed = [self.known[name] for name in others]
        sign_names = signs.dictionary.to_pylist()
        first_names = pieces.dictionary.take(pa.array(codes[first])).to_pylist()
        self._learn_bare([*sign_names, *first_names])
        packed += [self.bare[name] for name in (*sign_names, *first_names)]
        packed.append(b"")
        # Behind the remembered words come this batch's other pieces. A text's first piece is looked
        # up whole, and has no signs.
        base = len(self.lengths)
        lengths = np.concatenate([self.lengths, np.fromiter(map(len, packed), np.int64, len(packed)) // 4])
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(packed), "<u4")])
        place = np.zeros(len(words.dictionary), np.int64)
        place[used[~spaced]], place[used[spaced]] = usual, base + np.arange(len(others))
        number = np.stack([place[word], base + len(others) + sign], axis=1)
        number[first, 0] = base + len(others) + len(sign_names) + np.arange(len(first))
        number[first, 1] = base + len(packed) - 1
        rows_of_ids = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)])), pa.array(flat))
        found = rows_of_ids.take(pa.array(number[mine].ravel()))
        ids = found.flatten().to_numpy()
        ends = found.offsets.to_numpy()[2 * np.cumsum(sizes[even])] - found.offsets[0].as_py() if len(first) else []
        low = 0
        for i, high in zip([i for i, ok in zip(rows, even) if ok], ends):
            out[i] = ids[low:high]
            low = high
        return out

    def _rows_of(self, names: list[str]) -> np.ndarray:
        """The rows of distinct words without white space, each behind a blank, in the remembered ids."""
        if len(self.row) > WORDS:
            self.row, self.lengths, self.flat = {}, np.empty(0, np.int64), NO_IDS
        fresh = [name for name in names if name not in self.row]
        lengths, flat = [self.lengths], [self.flat]
        at = 0
        while at < len(fresh):
            end, size = at, 0
            while end < len(fresh) and size < CALL_CHARS:
                size += len(fresh[end]) + 2
                end += 1
            some = fresh[at:end]
            # A line feed between two words is an id of its own.
            ids = self._plain("\n " + "\n ".join(some) + "\n")
            cuts = np.flatnonzero(ids == self.feed) if self.feed is not None else ()
            if len(cuts) == len(some) + 1:
                lengths.append(np.diff(cuts) - 1)
                flat.append(np.delete(ids, cuts))
            else:
                single = [self._plain(" " + name) for name in some]
                lengths.append(np.array([len(x) for x in single], np.int64))
                flat += single
            self.row.update(zip(some, range(len(self.row), len(self.row) + len(some))))
            at = end
        self.lengths, self.flat = np.concatenate(lengths), np.concatenate(flat)
        return np.fromiter(map(self.row.__getitem__, names), np.int64, len(names))

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def _learn_bare(self, names: list[str]) -> None:
        if len(self.bare) > REMEMBERED:
            self.bare.clear()
        self._encode_all(set(names).difference(self.bare), self.bare, "")

    def _uneven(self, text: str) -> np.ndarray:
        """Cuts before each blank that follows something other than white space."""
        head, *pieces = BEHIND_TEXT.split(text)
        self._learn(self._unknown({p[1:] for p in pieces}))
        self._learn_bare([head])
        return np.frombuffer(self.bare[head] + b"".join([self.known[p[1:]] for p in pieces]), "<u4")


@functools.lru_cache(maxsize=1)
def _tokens(tokenizer: str) -> Tokens:
    return Tokens(tokenizer)


def pack_frame(doc_id: int, ids: np.ndarray) -> bytes:
    width = 2 if ids.max(initial=0) < 65536 else 4
    payload = struct.pack(PAYLOAD, doc_id, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of several batches, ``GATHERED`` characters and the last text beyond."""
    doc_ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            doc_ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= GATHERED:
                yield doc_ids, texts
                doc_ids, texts, size = [], [], 0
    if doc_ids:
        yield doc_ids, texts


def _writer(tokenizer, folder: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _tokens(tokenizer.value)
        files, root = open_folder(folder)
        files.create_dir(root, recursive=True)
        name = attempt_name("shard", ".bin")
        entries, count, low, offset = [], 0, None, 0
        with files.open_output_stream(f"{root}/{name}") as out:
            for doc_ids, texts in _gathered(batches):
                for doc_id, ids in zip(doc_ids, tokens.encode_all(texts)):
                    ids = np.append(ids, end_id)
                    frame = pack_frame(doc_id, ids)
                    out.write(frame)
                    entries.append(struct.pack(ENTRY, doc_id, offset, len(ids)))
                    offset += len(frame)
                    count += len(ids)
                    low = doc_id if low is None else low
        if entries:
            with files.open_output_stream(f"{root}/{name}.idx") as out:
                out.write(b"".join(entries))
            yield pd.DataFrame({
                "file": [name], "first_id": [low], "n_docs": [len(entries)], "n_ids": [count], "n_bytes": [offset],
            })
        else:
            files.delete_file(f"{root}/{name}")

    return run


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, files: int | None = None) -> tuple[str, DataFrame]:
    """Encodes ``docs`` (doc_id, text) and writes records in ascending doc_id order.

    Returns the folder and its manifest ``file, first_id, n_docs, n_ids, n_bytes, ids_before``.
    A null text is empty, a document without ids has its end id alone, rows with a null doc_id
    have no place in the order and are left out, repeated rows are written repeatedly. Other
    columns are ignored. No rows give an empty manifest.

    Texts move once, by ranges of doc_id. A task that is run again writes a file of another name;
    the manifest, written through Spark's committer, names the files of the tasks that counted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "records")
    with open(tokenizer, encoding="utf-8") as file:
        shared = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    parts = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = stage(rows.mapInPandas(
        _writer(shared, folder, end_id),
        "file string, first_id long, n_docs long, n_ids long, n_bytes long",
    ))
    # One row for each file.
    order = Window.orderBy("first_id", "file").rowsBetween(Window.unboundedPreceding, -1)
    return folder, manifest.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read_frame(source, offset: int | None = None) -> tuple[int, np.ndarray] | None:
    """The doc_id and ids of the record at ``offset``, or of the next one; None at the end."""
    if offset is not None:
        source.seek(offset)
    head = source.read(struct.calcsize(HEAD))
    if not head:
        return None
    length, check = struct.unpack(HEAD, head)
    if masked(head[:8]) != check:
        raise CorruptRecord("length")
    payload = source.read(length)
    if struct.unpack("<I", source.read(4))[0] != masked(payload):
        raise CorruptRecord("payload")
    doc_id, width = struct.unpack_from(PAYLOAD, payload)
    return doc_id, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(PAYLOAD))


def read_index(data: bytes) -> list[tuple[int, int, int]]:
    """doc_id, offset and number of ids of each record."""
    return list(struct.iter_unpack(ENTRY, data))


def _reader(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_folder(folder)
        for batch in batches:
            for file, before in zip(batch["file"], batch["ids_before"]):
                with files.open_input_stream(f"{root}/{file}.idx") as source:
                    index = read_index(source.read())
                rows, size = [], 0
                with files.open_input_stream(f"{root}/{file}", buffer_size=1 << 20) as source:
                    for doc_id, _, n in index:
                        found, ids = read_frame(source)
                        if found != doc_id or len(ids) != n:
                            raise CorruptRecord("index")
                        rows.append((doc_id, before, n, ids.astype("<u4").tobytes()))
                        before += n
                        size += n
                        if size > 2_000_000:
                            yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])

    return run


def read_records(folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every record; ids are packed as unsigned 32-bit integers."""
    # A stated number: adaptive execution would put so few rows into one task.
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = manifest.select("file", "ids_before").repartition(parts, "file")
    return rows.mapInPandas(_reader(folder), "doc_id long, start long, n_tokens long, ids binary")


def read_some(folder: str, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the records of ``wanted`` (doc_id), each found through the offset index.

    Files without a wanted document are not opened; of the others only the index and the wanted
    frames are read. A wanted id without a record gives no row.
    """
    spans = manifest.select("file", "first_id", F.lead("first_id").over(Window.orderBy("first_id", "file")).alias("next_id"))
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    pairs = asked.join(spans, (F.col("doc_id") >= F.col("first_id")) & (F.col("next_id").isNull() | (F.col("doc_id") <= F.col("next_id"))))
    pairs = pairs.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_folder(folder)
        for batch in batches:
            for file, rows in batch.groupby("file"):
                ids = set(rows["doc_id"])
                with files.open_input_stream(f"{root}/{file}.idx") as source:
                    hits = [(d, o) for d, o, _ in read_index(source.read()) if d in ids]
                with files.open_input_file(f"{root}/{file}") as source:
                    found = [read_frame(source, offset) for _, offset in hits]
                yield pd.DataFrame({"doc_id": [d for d, _ in found], "ids": [i.astype("<u4").tobytes() for _, i in found]})

    return pairs.mapInPandas(run, "doc_id long, ids binary")
