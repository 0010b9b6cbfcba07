"""Pre-tokens by written-out character classes, and the cache of their ids."""

import random
import re
import time

import pytest

from lakewright.llm import tokens
from lakewright.llm.queries import tokenizer_path

_N = "0-9²³¹¼½¾"
BY_CATEGORY = {
    "_JOINED": re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[^\W_{_N}]+| ?[{_N}]+| ?(?:_|[^\w\s])+|\s+(?!\S)|\s+"),
    "_BARE": re.compile(rf"[^\W_{_N}]+|[{_N}]|'(?:[stmd]|re|ve|ll)|(?:_|[^\w\s])+")}


def texts(n, seed=1):
    r = random.Random(seed)
    plain = [c for c in map(chr, range(0x250)) if not tokens._ODD.search(c)]
    words = ["the", "l'été", "Größe's", "we'll", "x_y", "__", "3½²", "a-b", "(c)", "ñ", "don't", "...", "Ångström", "\n", "\t ", "  "]
    return ["".join(r.choices(plain, k=r.randrange(60))) if i % 2 else " ".join(r.choices(words, k=r.randrange(40))) for i in range(n)]


@pytest.mark.parametrize("name", list(BY_CATEGORY))
def test_written_out_classes_split_alike_and_faster(name):
    new, old = getattr(tokens, name), BY_CATEGORY[name]
    assert all(new.findall(t) == old.findall(t) for t in texts(20_000))
    text = "Les maisons, déjà 12 fois größer; un-deux (trois) quatre's: " * 20_000
    took = {}
    for p in (old, new, old, new):
        began = time.process_time()
        p.findall(text)
        took[p] = min(took.get(p, 1e9), time.process_time() - began)
    assert took[new] < 0.8 * took[old], took


@pytest.mark.parametrize("file,joined", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_the_tokenizers_own_with_a_full_cache(file, joined):
    enc = tokens.ChunkEncoder(tokenizer_path(file), joined, cache_size=40)
    rows = texts(1_500, 2)
    for i in range(0, len(rows), 50):
        part = rows[i:i + 50]
        assert enc.encode(part) == enc._whole(part)
        assert not getattr(enc.pieces.old, "old", {})         # two generations at most
    assert enc.pieces.old
