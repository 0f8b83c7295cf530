import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from blkscope.llm import packing as K
from blkscope.llm.bpe import words_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, capacity):
    full = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = full.encode(t or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want.append((i, k, a, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in got)


def test_hard_rows_and_documents(hard, documents):
    for df in (hard, documents):
        for capacity in (2048, 64):
            got = K.best_fit_packing(df, PATH, capacity=capacity).collect()
            n, total = check([(r.doc_id, r.text) for r in df.collect()], got, capacity)
            assert n <= -(-total // capacity) + 1
    assert K.best_fit_packing(hard.limit(0), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20))
def test_plan_uses_every_piece_once(histogram):
    used = defaultdict(int)
    for times, parts in K.plan(histogram, 50):
        assert times > 0 and sum(n * c for n, c in parts) <= 50
        for n, c in parts:
            used[n] += times * c
    assert used == histogram


def test_two_pieces_replace_the_smallest():
    # greedy: 6+3, gap 1; instead of 3 the pieces 2+2 fill the gap of 4
    assert K._fill(6, [2, 3, 6], {6: 1, 3: 1, 2: 2}, 10) == {6: 1, 2: 2}


def ids_of(words, text):
    return np.frombuffer(b"".join(words.encode(words.split(text))), dtype="<u4").tolist()


def test_words_are_the_librarys_words():
    words, full = words_of(PATH), Tokenizer.from_file(PATH)

    @settings(max_examples=400, deadline=None)
    @given(st.text(max_size=60) | st.text(st.characters(max_codepoint=0x250), max_size=60) | st.text("ab '’sdrvDS½1\x85\xa0\x1c<|endoftext|>", max_size=40))
    def same(text):
        text = text.encode("utf-8", "ignore").decode()
        ids = ids_of(words, text)
        assert ids == full.encode(text, add_special_tokens=False).ids
        assert " ".join(words.pieces[i] for i in ids) == full.decode(ids, skip_special_tokens=False)

    same()
    for text in ("a<|endoftext|>b", "<|startoftext|><|endoftext|>", "x'll İ"):
        assert ids_of(words, text) == full.encode(text, add_special_tokens=False).ids


def test_memory_forgets_and_still_encodes(documents):
    texts = [r.text or "" for r in documents.limit(150).collect()]
    whole = K.Memory(PATH, 1 << 30).packed(texts)
    small = K.Memory(PATH, 500)
    assert [x for k in range(0, len(texts), 7) for x in small.packed(texts[k : k + 7])] == whole
    assert len(small.again) < 10_000 and K.memory_of(PATH) is K.memory_of(PATH)
