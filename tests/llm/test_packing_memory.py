"""What a packing worker remembers from one task to the next."""

from tablelens.llm import packing
from tablelens.llm.queries import tokenizer_path


def test_a_worker_keeps_the_chunks_seen_first(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 3)
    coder, texts = packing.ChunkTokenizer(tokenizer_path()), ["a few words", "and some more words to know"]
    want = [coder.ids([t])[0] for t in texts]
    known = list(coder.known.items())
    coder.forget()
    assert list(coder.known.items()) == known[:3]
    assert coder.ids(texts) == want == coder.encode(texts)
