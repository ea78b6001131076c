"""What a task of the word-level encoder holds."""

from pyspark.sql import functions as F

from ruleloom.llm import bpe


def test_a_task_keeps_no_second_copy_of_the_vocabulary(spark, monkeypatch):
    """Beside the encoder a worker holds the file's text only, and remembers ids without room to grow."""
    sent = []
    context = type(spark.sparkContext)
    plain = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(value) or plain(self, value))
    bpe.encode(spark, F.col("text"), bpe.default_vocabulary(), decoded=True)
    assert [type(v) for v in sent] == [bytes]
    encoder = bpe.Encoder(bpe.Spec.parse(sent[0]))
    first, again = encoder.encode("some words, some zzyqx words"), encoder.encode("some words, some zzyqx words")
    assert first == again and isinstance(first, list)
    assert all(isinstance(ids, tuple) for ids in [*encoder.words.values(), *encoder.chunks.values()])
