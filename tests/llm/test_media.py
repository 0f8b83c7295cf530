import hashlib
import random
import wave
import zlib
from io import BytesIO

from pyspark.sql import functions as F

from blkscope.llm import media as M


def plain(key, text):
    raw = (text or "").encode()
    data = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
    file = M.wav(data)
    with wave.open(BytesIO(file)) as w:
        assert (w.getnchannels(), w.getsampwidth()) == (1, 1) and w.readframes(w.getnframes()) == data
    return key, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(file), hashlib.sha256(file).hexdigest(), M.feature_of(data)


def test_hard_rows_and_documents(hard, documents):
    for df in (hard, documents):
        got = M.media_features(df)
        assert sorted(map(tuple, got.collect()), key=str) == sorted((plain(r.doc_id, r.text) for r in df.collect()), key=str)
    assert M.media_features(hard.limit(0)).count() == 0


def test_cuts_follow_content():
    rnd = random.Random(5)
    data = rnd.randbytes(200_000)
    ends = M.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(M.SHORTEST <= n <= M.LONGEST for n in sizes[:-1]) and len(ends) > 5
    h = lambda b: sum(int(M.GEAR[x]) << k for k, x in enumerate(reversed(b))) & ((1 << M.MASK_BITS) - 1)
    assert all(h(data[e - M.MASK_BITS : e]) == 0 for e, n in zip(ends[:-1], sizes) if n < M.LONGEST)
    moved = {data[a:b] for a, b in zip([0, *ends], ends)}
    other = b"something before" + data
    again = M.cuts(other)
    shared = sum(other[a:b] in moved for a, b in zip([0, *again], again))
    assert shared >= len(ends) - 2
    assert M.cuts(b"") == [0] and M.cuts(b"x") == [1] and M.cuts(b"\0" * 300_000)[0] <= M.LONGEST


def test_shared_chunks_are_stored_once(spark):
    body = "".join(random.Random(1).choices("abcdefgh ", k=60_000))
    df = spark.createDataFrame([(k, f"document {k} " + body) for k in range(8)], "doc_id long, text string")
    asked, stored = M.recipes(df), M.chunk_store(df, M.dictionary_of(df))
    assert asked.count() > 2 * stored.count()
    assert stored.groupBy("digest").count().filter("count > 1").count() == 0
    assert M.media_features(df).select(F.count_distinct("payload_sha256")).first()[0] == 8
