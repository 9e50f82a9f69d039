"""Media columns: content-defined chunks, deduplicated, from which verified media are put together again.

1. A document's text becomes a payload of whole frames and is stored as an audio file: 8-bit samples,
   one channel (`encode_media`).
2. A media file is cut where a rolling gear hash of its last bytes has zero bits, so that the same
   stretch of bytes is cut alike wherever it stands (`cut_points`).
3. The manifest has a row for each document: its content's key and the ordered digests of its
   chunks. Equal files are one content.
4. Chunks that several contents hold are found by an aggregate over digests; a join of the holders
   with its result tells each content which of these it is the home of. The store has each distinct
   chunk once: one container for each content, with the chunks whose home it is, compressed together
   with a dictionary that a bounded sample of chunks gave.
5. Every content is read back from the written store by its ordered list: its own container, and for
   chunks with another home a join on the digest that brings them from theirs. Each chunk's digest
   and the file's digest are verified; samples and features are taken from the file that was read back.

`stored` gives manifest and store, which are all that is needed to read media back: `chunks` gives the
store's single chunks, `restore` the files, `read_back` what the query reports of them. An exact copy
costs a row of the manifest, and is put together once. Copies of a content are combined before they
move. A chunk that a third of all contents hold is stored once; its holders are combined before they
meet, and the joins on its digest are in a form that adaptive execution can split.

Defined results: a null or empty text is a payload of padding alone. Rows with a null id and
repeated rows get a row each. An empty table gives an empty result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesieve.llm.common import cut_lineage, id_text_batches, small, with_id_and_text

FRAME = 576
PAD = b"\xff"
RATE = 8000

#: Chunks are at least so long, cut at one place in 2^CUT_BITS beyond that, and at most so long.
MIN_CHUNK, CUT_BITS, MAX_CHUNK = 256, 10, 8192

#: The gear hash holds the last 32 bytes: those before have been shifted out.
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: bytes, frame: int = FRAME) -> bytes:
    return text + PAD * (-len(text) % frame or (0 if text else frame))


def encode_media(payload: bytes, rate: int = RATE) -> bytes:
    """A WAVE file with the payload as unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def decode_media(media: bytes) -> bytes:
    """The samples of a file that encode_media made."""
    riff, _, wave, _, _, kind, channels, _, _, _, bits, data, size = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (riff, wave, kind, channels, bits, data) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or size != len(media) - 44:
        raise ValueError("not a WAVE file of 8-bit samples in one channel")
    return media[44:]


def gear_hashes(data: bytes) -> np.ndarray:
    """The rolling hash at each byte: the sum over the last 32 bytes of their gear values, shifted by their age."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < 32:  # a sum over twice the width is the sum over the width, and that of the width before it
        older = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += older
        width *= 2
    return h


def cut_points(data: bytes, least: int = MIN_CHUNK, bits: int = CUT_BITS, most: int = MAX_CHUNK) -> list[int]:
    """The ends of the chunks of data, in order."""
    marks = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - bits) == 0) + 1 if data else np.zeros(0, np.int64)
    ends, at = [], 0
    while at < len(data):
        k = int(np.searchsorted(marks, at + least))
        end = int(marks[k]) if k < len(marks) else len(data)
        at = min(end, at + most, len(data))
        ends.append(at)
    return ends


def chunks_of(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def assemble(order: list[bytes], plain: dict[bytes, bytes], key: bytes) -> tuple[bytes, bytes]:
    """The media file, and its SHA-256, from its ordered chunk digests and the chunks.

    Each chunk is verified by its digest and the file by key, the first bytes of its own.
    """
    for d in set(order):
        if d not in plain:
            raise ValueError("the store lacks a chunk")
        if digest(plain[d]) != d:
            raise ValueError("a stored chunk differs from its digest")
    media = b"".join(plain[d] for d in order)
    sha = hashlib.sha256(media).digest()
    if not sha.startswith(key):
        raise ValueError("the media differ from their digest")
    return media, sha


def features(media: bytes, n_chunks: int) -> tuple[int, bytes, int, str]:
    """Length and SHA-256 of the payload, checksum of its tail, and features, from the samples of a media file that was read back."""
    samples = decode_media(media)
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int16) - 128
    crossings = int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum())
    told = f"chunks={n_chunks};mean={x.mean():.4f};peak={int(np.abs(x).max())};crossings={crossings}"
    return len(samples), hashlib.sha256(samples).digest(), zlib.crc32(samples[-32:]), told


#: Contents are told apart by so many first bytes of their media file's SHA-256 while they are on their way.
KEY_BYTES = 16
DIGEST_BYTES = 16

#: Compression of containers: level, size of the dictionary, and the number of chunks it is made of. No result depends on it.
LEVEL, DICTIONARY_BYTES, SAMPLE_CHUNKS = 9, 200_000, 4096

MANIFEST = "doc_id long, n_bytes long, key binary, digests binary"
#: digests: the ordered list. foreign: those with another home. lent: those that other contents hold too. sizes: bytes of each own chunk. container: own chunks, compressed.
STORE = "key binary, digests binary, foreign binary, lent binary, sizes binary, container binary"
READ = "key binary, media_bytes long, media_sha binary, payload_bytes long, payload_sha binary, tail_crc32 long, feature string"
CHUNK = "digest binary, chunk binary"
MEDIA = "key binary, media binary"
HOLDER = "d1 long, d2 long, k1 long, k2 long"

_KINDS = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(cols, kinds)], names=list(names))


def _listed(joined: bytes | None) -> list[bytes]:
    return [joined[k : k + DIGEST_BYTES] for k in range(0, len(joined or b""), DIGEST_BYTES)]


def _longs(joined: bytes) -> np.ndarray:
    """16-byte values, joined, as rows of two longs."""
    return np.frombuffer(joined, dtype="<i8").reshape(-1, 2)


def manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each document: its length, its content's key and the ordered digests of its chunks, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in id_text_batches(batches):
            rows = []
            for i, t in zip(ids.to_pylist(), texts):
                m = encode_media(payload_of(t))
                rows.append((i, len(t), hashlib.sha256(m).digest()[:KEY_BYTES], b"".join(map(digest, chunks_of(m)))))
            yield _batch(rows, MANIFEST)

    return with_id_and_text(docs, id_col, text_col).mapInArrow(run, MANIFEST)


def holders(listed: DataFrame) -> DataFrame:
    """(d1, d2, k1, k2): digests and keys of the contents that hold them, of each batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            if own:
                of = [np.unique(_longs(d), axis=0) for d in own.values()]
                keys = np.repeat(_longs(b"".join(own)), [len(x) for x in of], axis=0)
                both = np.concatenate(of)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for x in (both, keys) for k in (0, 1)], names=["d1", "d2", "k1", "k2"])

    return listed.select("key", "digests").mapInArrow(run, HOLDER)


def homes(listed: DataFrame) -> DataFrame:
    """Per content that holds chunks which others hold too: k1, k2 and these chunks with whether their home is here.

    A chunk's home is the holder with the smallest first half of its key (should two keys share it,
    either stores the chunk).
    """
    held = holders(listed)
    shared = cut_lineage(held.groupBy("d1", "d2").agg(F.min("k1").alias("home"), F.max("k1").alias("last")).where(F.col("home") < F.col("last")).select("d1", "d2", "home"))
    found = held.join(small(shared), ["d1", "d2"])
    return found.groupBy("k1", "k2").agg(F.collect_set(F.struct("d1", "d2", (F.col("k1") == F.col("home")).alias("here"))).alias("shared"))


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunks: int = SAMPLE_CHUNKS, size: int = DICTIONARY_BYTES) -> bytes:
    """A compression dictionary from a bounded sample: so many chunks, of at most MAX_CHUNK bytes each; empty if they are too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in id_text_batches(batches):
            for t in texts:
                yield _batch([(b"", c) for c in chunks_of(encode_media(payload_of(t)))[:chunks]], CHUNK)

    sample = [bytes(r.chunk) for r in with_id_and_text(docs, id_col, text_col).mapInArrow(run, CHUNK).limit(chunks).collect()]
    try:
        return zstandard.train_dictionary(size, list(dict.fromkeys(sample))).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(words: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdCompressor(level=LEVEL)


def _decompressor(words: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()


def containers(docs: DataFrame, at_home: DataFrame, words: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The store's rows: of each content its ordered list, and a container of the chunks whose home it is. The dictionary is the row with an empty key."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = _compressor(words)
        for _, texts in id_text_batches(batches):
            own: dict[bytes, bytes] = {}  # of this batch alone
            for t in texts:
                m = encode_media(payload_of(t))
                if (key := hashlib.sha256(m).digest()[:KEY_BYTES]) not in own:
                    own[key] = z.compress(m)
            keys = _longs(b"".join(own))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, k])) for k in (0, 1)] + [pa.array(own.values(), pa.binary())], names=["k1", "k2", "media"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, back = _compressor(words), _decompressor(words)
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)
            rows = []
            for key, whole, shared in zip(keys, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                parts = chunks_of(back.decompress(whole))
                order = list(map(digest, parts))
                away = {struct.pack("<qq", x["d1"], x["d2"]) for x in shared or () if not x["here"]}
                lent = {struct.pack("<qq", x["d1"], x["d2"]) for x in shared or () if x["here"]}
                own = {d: p for d, p in zip(order, parts) if d not in away}
                if len(own) < len(order):  # else the content as a whole is its container
                    whole = z.compress(b"".join(own.values()))
                rows.append((key.tobytes(), b"".join(order), b"".join(sorted(away)), b"".join(sorted(lent)), np.array([*map(len, own.values())], dtype="<u4").tobytes(), whole))
            yield _batch(rows, STORE)

    media = with_id_and_text(docs, id_col, text_col).mapInArrow(squeeze, "k1 long, k2 long, media binary").groupBy("k1", "k2").agg(F.first("media").alias("media"))
    filled = media.join(at_home, ["k1", "k2"], "left").select("k1", "k2", "media", "shared").mapInArrow(fill, STORE)
    none = bytearray()
    return filled.unionByName(docs.sparkSession.createDataFrame([(none, none, none, none, none, bytearray(words))], STORE))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The manifest and the chunk store, both written."""
    listed = cut_lineage(manifest(docs, id_col, text_col))
    return listed, cut_lineage(containers(docs, homes(listed), dictionary(docs, id_col, text_col), id_col, text_col))


def _dictionary_of(store: DataFrame) -> bytes:
    return bytes(store.where(F.length("key") == 0).select("container").first()[0])


def _opened(batch: pa.RecordBatch, back: zstandard.ZstdDecompressor) -> Iterator[tuple[bytes, list[bytes], dict[bytes, bytes], list[bytes]]]:
    """Key, ordered list, own chunks by digest and lent digests of store rows."""
    for key, order, away, lent, sizes, container in zip(*(batch.column(k).to_pylist() for k in range(6))):
        order, away, lent = _listed(order), set(_listed(away)), _listed(lent)
        whole = back.decompress(container)
        ends = np.cumsum(np.frombuffer(sizes, dtype="<u4"), dtype=np.int64).tolist()
        names = dict.fromkeys(d for d in order if d not in away)
        yield key, order, {d: whole[a:b] for d, a, b in zip(names, [0, *ends], ends)}, lent


def chunks(store: DataFrame, lent: bool = False) -> DataFrame:
    """(digest, chunk) of the store, each distinct chunk once; lent: only those that several contents hold, compressed."""
    words = _dictionary_of(store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, back = _compressor(words), _decompressor(words)
        for batch in batches:
            yield _batch([(d, z.compress(own[d]) if lent else own[d]) for _, _, own, some in _opened(batch, back) for d in (some if lent else own)], CHUNK)

    rows = store.where((F.length("lent") if lent else F.length("key")) > 0)
    return rows.mapInArrow(run, CHUNK)


def _assembled(store: DataFrame, row, schema: str) -> DataFrame:
    """A row (key, ordered list, media file, its SHA-256) -> tuple of schema for each content of the store."""
    words = _dictionary_of(store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _decompressor(words)
        for batch in batches:
            fetched = batch.column(6).to_pylist() if batch.num_columns > 6 else [None] * batch.num_rows
            out = []
            for (key, order, own, _), more in zip(_opened(batch, back), fetched):
                own |= {x["digest"]: back.decompress(x["chunk"]) for x in more or ()}
                out.append(row(key, order, *assemble(order, own, key)))
            yield _batch(out, schema)

    # most contents are whole in their container; for the others the join on the digest brings what is elsewhere
    whole = store.where((F.length("key") > 0) & (F.length("foreign") == 0)).mapInArrow(run, schema)
    other = store.where(F.length("foreign") > 0)
    starts = F.sequence(F.lit(1), F.length("foreign"), F.lit(DIGEST_BYTES))
    wanted = other.select("key", F.explode(F.transform(starts, lambda k: F.substring("foreign", k, F.lit(DIGEST_BYTES)))).alias("digest"))
    fetched = wanted.join(chunks(store, lent=True), "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "chunk")).alias("fetched"))
    joined = other.join(fetched, "key", "left").select(*other.columns, "fetched")
    return whole.unionByName(joined.mapInArrow(run, schema))


def restore(store: DataFrame) -> DataFrame:
    """(key, media): each content's file, put together from the store."""
    return _assembled(store, lambda key, _, media, __: (key, media), MEDIA)


def read_back(listed: DataFrame, store: DataFrame) -> DataFrame:
    """Per document of the manifest, from its media as put together from the store: the columns of `media`."""
    read = _assembled(store, lambda key, order, media, sha: (key, len(media), sha, *features(media, len(order))), READ)
    out = listed.select("doc_id", "n_bytes", "key").join(read, "key", "left")
    found = F.when(F.col("media_sha").isNull(), F.raise_error(F.lit("the store lacks a content"))).otherwise(F.col("media_bytes"))
    return out.select("doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload_sha")).alias("payload_sha256"), "tail_crc32", found.alias("media_bytes"), F.lower(F.hex("media_sha")).alias("media_sha256"), "feature")


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature."""
    return read_back(*stored(docs, id_col, text_col))
