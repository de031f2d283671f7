"""What a worker holds while it encodes texts in which nearly every word is new."""

import tracemalloc

from tilespark.llm import bpe
from tilespark.llm.queries import tokenizer


def test_caches_stay_small():
    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f:
        coder = bpe.Bpe(f.read())
    most = 0
    tracemalloc.start()
    try:
        for lo in range(0, 260_000, 20_000):
            coder.encode_batch([" ".join(f"{(i * 7919) % 1000003:x}," for i in range(lo, lo + 20_000))])
            most = max(most, tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
    assert most < 40e6
