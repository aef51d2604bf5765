import random
import zlib

from leafloom.llm import quality


def test_packed_size_covers_whole_text():
    """Bytes behind the first million count, and short texts keep their feature."""
    at, rnd = quality.FEATURES.index("packed_size"), random.Random(1)
    head, noise = b"same words again " * 60_000, rnd.randbytes(1_500_000)
    for text in (b"", b"x", b"some prose of a few words", head, head + noise, noise + head):
        assert quality.features(text)[at] == len(zlib.compress(text, 1)) / max(1, len(text))
    assert quality.features(head + noise)[at] > 10 * quality.features(head)[at]
