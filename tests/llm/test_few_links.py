"""What is small stays in few tasks, and in little memory."""

import sys

import public_tokenizers

from millrace.llm import bpe_codec
from millrace.llm.components import components
from millrace.llm.vocabulary import Vocabulary, read_vocabulary


def test_few_links_are_held_in_few_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(k, k + 1) for k in range(0, 40) if k % 10 != 9], "a long, b long")
        found = components(links)
        assert found.rdd.getNumPartitions() <= 4
        assert {r.node: r.component for r in found.collect()} == {k: k // 10 * 10 for k in range(40)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pairs_take_the_same_memory_however_many():
    vocabulary = Vocabulary(read_vocabulary(public_tokenizers.path(bpe_codec.DEFAULT_VOCABULARY)))
    texts = [f"unimaginable{k} counter-intuitively{k * k} zqxj{k}vw überraschend{k}" for k in range(300)]
    few, many = bpe_codec.Encoder(vocabulary, 50, 4), bpe_codec.Encoder(vocabulary)
    before = sys.getsizeof(few.stands)
    assert [few.packed(x) for x in texts] == [many.packed(x) for x in texts]
    assert sys.getsizeof(few.stands) == before <= 4 * 8 + 200
