import public_tokenizers
from tokenizers import Tokenizer

from blkscope.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip_is_the_librarys(hard, documents):
    full = Tokenizer.from_file(PATH)
    for df, block_bytes in ((hard, 1 << 20), (documents, 40_000), (documents, 1 << 24)):
        want = []
        for r in df.collect():
            ids = full.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, ids, full.decode(ids, skip_special_tokens=False)))
        got = [(r.doc_id, list(r.ids), r.decoded) for r in bpe.encode_decode(df, PATH, block_bytes=block_bytes).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encode_decode(hard.limit(0), PATH).count() == 0


def test_a_word_has_one_shard_and_is_listed_once_a_block(documents):
    lists = bpe.block_words(bpe.dealt(documents, 5, str.encode), PATH, 12)
    words = lists.collect()
    per_shard = {}
    for r in words:
        assert (r.block, r.shard) not in per_shard
        per_shard[r.block, r.shard] = bpe._unzip(bytes(r.words)).decode().split("\n")
    homes = {}
    for (_, shard), own in per_shard.items():
        assert own == sorted(set(own))
        for w in own:
            assert homes.setdefault(w, shard) == shard


def rows_of_joins(node) -> int:
    """What the joins below a node of a plan that has run gave, each counted once."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return rows_of_joins(node.executedPlan())
    if name.endswith("QueryStage"):
        return rows_of_joins(node.plan())
    below = [] if name == "ReusedExchange" else [node.children().apply(k) for k in range(node.children().size())]
    return sum(map(rows_of_joins, below)) + ("Join" in name and node.metrics().apply("numOutputRows").value())


def test_the_join_with_the_vocabulary_follows_the_words_not_the_blocks(documents):
    size = sum(len((r.text or "").encode()) for r in documents.collect())
    got = []
    for blocks in (4, 15):  # 12 shards for either
        made = bpe.encode_decode(documents, PATH, block_bytes=-(-size // blocks))
        rows = sorted((r.doc_id, list(r.ids), r.decoded) for r in made.collect())
        got.append((rows, rows_of_joins(made._jdf.queryExecution().executedPlan())))
    assert got[0] == got[1]
    assert got[0][1] > 0
