import numpy as np

from lexiforge.llm.media import BLOCK, FRAME, peaks


def test_every_block_lies_in_a_frame():
    for blocks in range(1, 20):
        samples = np.full(blocks * BLOCK, 128, dtype=np.uint8)
        assert len(peaks(samples)[0]) == 0
        samples[-BLOCK:] = 128 + 100 * np.sin(np.arange(BLOCK))
        assert len(peaks(samples)[0]) > 0, blocks
    assert set(peaks(np.full(FRAME, 128, dtype=np.uint8))[0]) == set()
