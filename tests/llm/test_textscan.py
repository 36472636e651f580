"""What a worker keeps of the texts it has read."""

from panelfold.llm import textscan
from panelfold.llm.wordscan import Words, byte_table


def test_tables_follow_the_texts(monkeypatch):
    monkeypatch.setattr(textscan, "_CACHE", {})
    Words([b"a few words"] * 1000, byte_table(b" "))
    assert sum(t.nbytes for t in textscan._CACHE.values()) <= 1 << 23
