import random

from featsel.llm import toxicity as t


def test_steps_read_every_character():
    cjk = "".join(chr(0x4E00 + i) for i in range(200)).encode()
    assert b"".join(t.steps(cjk)) == cjk and all(0 < len(x) <= t.LONGEST for x in t.steps(cjk))
    assert all(x.decode() for x in t.steps(cjk))
    words = [f"word{i}" for i in range(30)]
    for sep in "_,/ 　 ":
        assert t.steps(sep.join(words).encode()) == [w.encode() for w in words]
    text = b"short_run stays, so " + b"!" * 60 + b" don't"
    assert t.steps(text) == text.split()
    assert b"".join(t.steps(b"x" * 95 + b"\xff" * 30)) == b"x" * 95 + b"\xff" * 30
    assert t.steps("。".encode() * 50) and t.steps(b"") == []


def test_toxic_phrase_after_byte_40_of_a_word():
    r = random.Random(3)
    calm = ["".join(r.choice("aeioulmnr") for _ in range(6)) for _ in range(80)]
    some = lambda n: [r.choice(calm) for _ in range(n)]
    phrase = ["filthy", "stupid", "scum"]
    texts = [*(" ".join([*some(8), *phrase, *some(5)]) for _ in range(120)), *(" ".join(some(16)) for _ in range(240))]
    net = t.train([x.encode() for x in texts], [1] * 120 + [0] * 240)
    for sep in "_,/ 　":
        quiet, toxic = (sep.join([*some(10), *tail, *some(2)]).encode() for tail in (some(3), phrase))
        low, high = t.Scorer(net)([quiet, toxic])
        assert low < t.TOXIC <= high, (sep, low, high)


def test_training_reads_words_to_their_end():
    r = random.Random(5)
    some = lambda n: "".join(chr(0x4E00 + r.randrange(300)) for _ in range(n))
    tail = "".join(chr(0x6000 + i) for i in range(26))
    texts = [*(some(26) + tail for _ in range(120)), *(some(52) for _ in range(240))]
    net = t.train([x.encode() for x in texts], [1] * 120 + [0] * 240)
    low, high = t.Scorer(net)([some(52).encode(), (some(26) + tail).encode()])
    assert low < t.TOXIC <= high
