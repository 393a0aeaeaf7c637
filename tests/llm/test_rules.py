"""Every byte of a text of more than one chunk lies in a judged one."""

import random

import zstandard

from assayer.llm import rules


def test_short_last_chunk_is_judged():
    rng = random.Random(8)
    press = zstandard.ZstdCompressor(level=rules.LEVEL).compress
    prose = b"".join(b"%s " % bytes(rng.choices(b"etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(2000))[:4100]
    good, bad = (rules.ratios(memoryview(prose + end), press)[1] for end in (b"", b"x" * 1900))
    assert len(good) == len(bad) == 2 and max(good) < 3 < bad[1]
    assert rules.ratios(memoryview(prose[:1000]), press)[1] == []
