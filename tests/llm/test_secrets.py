import hashlib
import random
import re

import numpy as np

from pulso.llm import secrets_cnn as S

from .helpers import documents, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text or "") if len(m.group(2)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m.group()) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


TEXTS = [None, "", "é password = 'abcdef' x", "password=abc token: \"abcdefgh\"", "password=token :abcdefg",
         "PASSWD:abcdef ſecret=abcdefgh apiKey=zzzzzzz API_KEY = 'q1w2e3r4'", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "é",
         "AKIAxAKIA" + "Z9" * 10, "f" * 23 + " " + "f" * 24, "token=" + "0123456789abcdef" * 2, "secret" * 20 + "=abcdef",
         "漢字 " * 5000 + "secret: 123456", "deadbeef" * 3, "token=", "api__key=abcdefg"]


def test_base_spans_equal_python_regexes(spark):
    rnd = random.Random(7)
    bits = ["password", "token", "=", ":", " ", "'", "AKIA", "AAAA9999BBBB0000", "deadbeef01", "é", "api_key", "x1y2z3"]
    texts = TEXTS + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25))) for _ in range(300)]
    rows = sorted(S.digest(S.scan(documents(spark, texts), None)).collect(), key=lambda r: r.doc_id)
    for t, r in zip(texts, rows):
        want = ",".join(base(t))
        assert r.spans == want, t
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def corpus(rnd, n):
    texts = []
    for i in range(n):
        key = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        more = [f'token = "{key}"', f"mail bob.{rnd.randrange(99)}@mail{i % 9}.example.com", f"card {rnd.randrange(10**15, 10**16)}",
                f"see www.site{rnd.randrange(100)}.example.org"]
        texts.append(f"{prose(rnd, 20)} {rnd.choice(more)} {prose(rnd, 10)}")
    return texts


def test_network_learns_keeps_recall_and_is_repeatable(spark):
    rnd = random.Random(8)
    docs = documents(spark, corpus(rnd, 400))
    model = S.train(docs)
    again = S.train(docs)
    assert np.allclose(model.w["conv"], again.w["conv"])
    unseen = documents(spark, corpus(rnd, 200))
    found = S.findings(unseen).collect()
    p = model.score(np.array([np.frombuffer(r.chars, np.uint8) for r in found]).astype(np.int16))
    y = np.array([r.label for r in found])
    assert (p[y == 1] >= model.threshold).mean() >= S.RECALL - 0.02
    assert (p[y == 0] >= model.threshold).mean() <= 0.05
    assert 0 <= p.min() and p.max() <= 1
    # keys whose name and letters no base rule knows, beside what is no key
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    planted = []
    for i in range(120):
        alphabet = [letters, letters[26:], letters[:26] + letters[52:]][i % 3]
        key = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([32, 40, 40, 64, 120])))
        name = rnd.choice(["auth", "client_id", "sig", "credential", "x_key"])
        planted.append(f'{prose(rnd, 12)} {name}{rnd.choice([" = ", "=", ": "])}"{key}" {prose(rnd, 8)}')
    rows = S.digest(S.scan(documents(spark, planted), model)).collect()
    assert all(r.n_assign + r.n_access + r.n_hex == 0 for r in rows)
    assert np.mean([r.n_cnn > 0 for r in rows]) >= 0.9
    plain = S.digest(S.scan(documents(spark, [t for t in corpus(rnd, 300) if "token" not in t] + ["plain words only"]), model))
    assert np.mean([r.n_cnn > 0 for r in plain.collect()]) <= 0.05


def test_long_tokens_are_read_whole():
    text = "x = " + "a" * 200 + "1" * 30
    data, offs = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    s, e = S.candidates(data, offs)
    rows, own = S.windows(data, offs, s, e)
    body = rows[:, S.LEFT:S.LEFT + S.BODY]
    step = S.BODY - S.WIDTH + 1
    seen = np.zeros(e[0] - s[0], bool)
    for k, b in enumerate(body):
        n = (b > 0).sum()
        assert bytes(b[:n].astype(np.uint8)).decode() == text[4:][k * step:k * step + n]
        seen[k * step:k * step + n] = True
    assert seen.all() and (own == 0).all() and len(rows) > 4
    short = S.windows(data, offs, s, s + S.BODY)[0]
    assert len(short) == 1


def test_no_trigger_is_left_in_a_disguise():
    for seed, text in enumerate(t for t in TEXTS if t):
        data = np.frombuffer(text.encode(), np.uint8)
        offs = np.array([0, len(data)])
        out = S.disguised(data, S.base_spans(data, offs), seed)
        kinds = {k for *_, k in S.base_spans(out, offs)}
        assert 0 not in kinds or text == "token=" or "secret" * 2 in text
        assert len(out) == len(data) and S.disguised(data, [], seed).tobytes() == data.tobytes()


def test_gradients():
    g = np.random.default_rng(2)
    net = S.CharCnn()
    x = g.integers(0, 128, (6, S.LEFT + S.BODY + S.RIGHT)).astype(np.int16)
    y = g.integers(0, 2, 6).astype(float)
    loss = lambda: float(np.mean(np.log1p(np.exp(net._forward(x)[3])) - y * net._forward(x)[3]))
    grads = net._gradients(x, y, np.ones(6))
    for name in net.w:
        k = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old = net.w[name][k]
        net.w[name][k] = old + 1e-5
        up = loss()
        net.w[name][k] = old - 1e-5
        down = loss()
        net.w[name][k] = old
        assert abs((up - down) / 2e-5 - grads[name][k]) < 1e-4 * max(1, abs(grads[name][k]))


def test_redaction(spark):
    texts = TEXTS + ["deadbeef" * 4, "deadbeef" * 4 + "token=abcdefgh"]
    rows = {r.doc_id: r for r in S.redact(documents(spark, texts), None).collect()}
    for i, t in enumerate(texts):
        want, reach = "", 0
        for k, a, b in sorted((x.split(":") for x in base(t)), key=lambda x: int(x[1])):
            a, b = int(a), int(b)
            if a > reach or not want and not reach:
                want += t[reach:a] + "[SECRET]"
                reach = a
            reach = max(reach, b)
        want = t if t is None else want + t[reach:]
        assert rows[i].text == want
        assert rows[i].n_chars == (None if t is None else len(want))
        assert rows[i].component == "x"


def test_without_both_classes_nothing_is_trained(spark):
    assert S.train(documents(spark, ["plain", None])) is None
    assert S.scan(documents(spark, ["x"]).where("false"), None).collect() == []
    assert S.train(documents(spark, ["x"]).where("false")) is None


def test_every_finding_trains_the_network(spark, monkeypatch):
    """Before, at most 3,000 findings of about 8,000 documents were trained on."""
    monkeypatch.setattr(S, "SHARD", 100)
    seen = []
    calibrate = S.CharCnn.calibrate
    monkeypatch.setattr(S.CharCnn, "calibrate", lambda self, z, y, n: (seen.append((n * y).sum()), calibrate(self, z, y, n)))
    sizes = []
    whole = S._round
    monkeypatch.setattr(S, "_round", lambda rows, *a: (sizes.append(rows.agg({"n": "sum"}).first()[0]), whole(rows, *a))[1])
    monkeypatch.setattr(S, "EPOCHS", 1)
    docs = documents(spark, corpus(random.Random(12), 9000))
    model = S.train(docs)
    rows = S.findings(docs)
    assert model is not None and rows.count() > 3000
    held = (seen[0], rows.count() - sizes[0])
    assert 0 < held[0] < held[1] and abs(held[1] / rows.count() - 0.25) < 0.05


def test_every_round_is_run_at_every_size(spark, monkeypatch):
    """Before, more than 24,576 rows were trained on in one round instead of ``EPOCHS``."""
    rnd = random.Random(13)
    hexes = lambda n: " ".join(f"{rnd.getrandbits(128):032x}" for _ in range(n))
    words = lambda n: " ".join(f"Site{rnd.getrandbits(40):013d}" for _ in range(n))
    rounds = []

    def counted(rows, model, weights, number):
        rounds.append((number, rows.count()))
        return model.flat()

    monkeypatch.setattr(S, "_round", counted)
    assert S.train(documents(spark, [f(500) for _ in range(36) for f in (hexes, words)])) is not None
    assert [n for n, _ in rounds] == list(range(S.EPOCHS))
    assert all(k > 24576 for _, k in rounds)


def test_a_finding_repeated_weighs_as_often():
    g = np.random.default_rng(3)
    z, y = g.normal(0, 2, 400), g.integers(0, 2, 400).astype(float)
    n = g.integers(1, 4, 400)
    a, b = S.CharCnn(), S.CharCnn()
    a.calibrate(z, y, n)
    b.calibrate(np.repeat(z, n), np.repeat(y, n), np.ones(n.sum()))
    assert np.allclose([a.slope, a.offset, a.threshold], [b.slope, b.offset, b.threshold])
