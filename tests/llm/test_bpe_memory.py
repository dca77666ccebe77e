from __future__ import annotations

import gc
import tracemalloc

from rasterlens.llm import bpe
from rasterlens.llm.common import tokenizer_path


def test_a_cached_word_costs_its_ids_and_no_more():
    """Two generations of the cache are most of a worker's memory: 250 bytes a word were too many."""
    path = tokenizer_path("word_bpe_49k.json")
    own = bpe.WordBpe(path)
    own.cache.most = 20_000
    words = [f"{chr(97 + i % 26)}q{chr(97 + i // 26 % 26)}x{chr(97 + i // 676 % 26)}zj" for i in range(17_576)]
    own.raw("warm up")
    tracemalloc.start()
    for w in words:
        own.raw(w)
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(own.cache) >= 17_576 and held < 200 * len(words)
    text = "<|endoftext|> " + " ".join(words[:50]) + " Straße, it's 42 中文"
    assert own.decode(own.encode(text)) == bpe._library(path).decode(bpe._library(path).encode(text, add_special_tokens=False).ids, skip_special_tokens=False)
