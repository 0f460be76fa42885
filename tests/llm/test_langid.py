"""Language identification: gradients, held-out accuracy, whole texts, odd rows."""

import random
import zlib

import numpy as np

from tidemark.llm import langid

SYLLABLES = {"xx": "ka to mi re su na lo".split(), "yy": "schw pfe ung lich ßer ein ö".split(), "zz": "eau oux ille é ent ç è".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    return [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.choice([4, 30, 300])), lang, "src") for i in range(n)]


def test_gradient():
    rng = np.random.default_rng(1)
    net = langid.ByteConvNet(["a", "b", "c"])
    x, y = rng.integers(0, 256, (5, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 5)

    def loss():
        net_out = langid.predict({**net.compiled(), "tables": {w: [net.p["embed"] @ net.p[f"w{w}"][j] for j in range(w)] for w in langid.WIDTHS}, "out": net.p["out"], "shift": {w: net.p[f"b{w}"] for w in langid.WIDTHS}}, [bytes(r) for r in x])
        return -np.log(net_out[np.arange(5), y]).mean()

    g = net._gradient(x, y)
    for name in ("out", "bias", "w2", "b3", "embed"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_held_out_accuracy_and_rows(spark):
    rows = corpus() + [(1000, None, "xx", "s"), (1001, "", "xx", "s"), (1002, "12 34 !?", "yy", "s"), (1003, "ka to", None, "s"), (1003, "ka to", None, "s")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")
    held = {r.doc_id: r.h for r in docs.select("doc_id", langid.held_out().alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())
    net = langid.fit(docs.where(~langid.held_out()))
    got = langid.identify(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1000] == by[1001] == by[1002] == "und" and by[1003] == "xx"
    tested = [(i, lang) for i, _, lang, _ in rows[:300] if held[i]]
    assert sum(by[i] == lang for i, lang in tested) / len(tested) > 0.95
    again = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs.repartition(5), langid.fit(docs.where(~langid.held_out()).repartition(3))).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in got}


def test_whole_texts_count():
    rng = random.Random(3)
    rows = corpus(200, 4)
    labels = np.array([list(SYLLABLES).index(r[2]) for r in rows])
    cut = [langid.windows_of(r[1].encode()) for r in rows]
    x = np.frombuffer(b"".join(cut), np.uint8).reshape(-1, langid.WINDOW)
    net = langid.ByteConvNet(list(SYLLABLES)).train(x, np.repeat(labels, [len(c) // langid.WINDOW for c in cut])).compiled()
    tail = prose(rng, "xx", 50) + " " + prose(rng, "yy", 4000)
    assert net["languages"][int(langid.predict(net, [tail.encode()])[0].argmax())] == "yy"
    bodies = [r[1].encode() for r in rows[:20]]
    assert np.allclose(langid.predict(net, bodies), np.concatenate([langid.predict(net, [b]) for b in bodies]))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.fit(docs) is None and langid.fit(docs.limit(0)) is None
    row = langid.identify(docs, None).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def plain_prediction(net, body):
    """The network by plain loops: windows of bytes, each filter's largest response, softmax, mean over the windows."""
    size, windows = langid.WINDOW, max(1, -(-len(body) // langid.WINDOW))
    body = body + b"\0" * (windows * size - len(body))
    total = [0.0] * len(net.languages)
    for n in range(windows):
        window, hidden = body[n * size : (n + 1) * size], []
        for w in langid.WIDTHS:
            for f in range(langid.FILTERS):
                responses = [sum(net.p["embed"][window[i + j]][e] * net.p[f"w{w}"][j][e][f] for j in range(w) for e in range(langid.EMBED)) for i in range(size - w + 1)]
                hidden.append(max(0.0, max(responses) + net.p[f"b{w}"][f]))
        logits = [sum(h * net.p["out"][k][c] for k, h in enumerate(hidden)) + net.p["bias"][c] for c in range(len(total))]
        top = max(logits)
        odds = [np.exp(z - top) for z in logits]
        total = [t + o / sum(odds) for t, o in zip(total, odds)]
    return [t / windows for t in total]


def test_predictions_by_plain_loops():
    net = langid.ByteConvNet(["a", "b", "c"])
    net.p["b2"], net.p["bias"] = np.linspace(-0.2, 0.2, langid.FILTERS), np.array([0.1, 0.0, -0.1])
    rng = random.Random(2)
    bodies = [b"", "é".encode(), prose(rng, "yy", 9).encode(), prose(rng, "zz", 60).encode(), bytes(range(256))]
    assert np.allclose(langid.predict(net.compiled(), bodies), [plain_prediction(net, b) for b in bodies], atol=1e-5)


def test_a_row_that_fills_the_table_counts_once(spark):
    """Half of all rows are one row, and one language has a single text: every label is learned."""
    rows = corpus(120, 7) + [(5000, "ka to mi re", "xx", "s")] * 120 + [(6000, "schw pfe ung lich", "qq", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    net = langid.fit(docs)
    assert net.languages == ["qq", "xx", "yy", "zz"]
    again = langid.fit(docs.distinct().repartition(5))
    assert all(np.array_equal(net.p[k], again.p[k]) for k in net.p)
