"""What a task of the FLAC operator holds while it encodes and decodes a batch of texts."""

import random
import tracemalloc

import pyarrow as pa

from tilespark.llm import flac


class Plan:
    """Stands for a DataFrame: gives the function that mapInArrow would send to tasks."""

    def select(self, *_):
        return self

    def mapInArrow(self, work, schema):
        return work


def most_mb(work):
    tracemalloc.start()
    try:
        got = work()
        return got, tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_batches_are_coded_in_bounded_memory():
    rng = random.Random(3)
    words = ["".join(rng.choice("aeiorstln") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(400, 700))) for _ in range(1300)]  # about 4 MB
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    made, mb = most_mb(lambda: list(flac.text_media(Plan())(iter([batch]))))
    assert mb < 90
    media = [m for b in made for m in b.column("media").to_pylist()]
    assert [n for b in made for n in b.column("n_bytes").to_pylist()] == [len(t) for t in texts]
    (samples, offs), mb = most_mb(lambda: flac.decode(media[:700]))
    assert mb < 70
    for i, text in enumerate(texts[:700]):
        assert samples[offs[i] : offs[i + 1]].tobytes().rstrip(b"\0").decode() == text
