import random

import numpy as np
import pyarrow as pa

from spanloom.llm import leakage as L

WORDS = [f"w{i}" for i in range(60)]


def brute(docs, items):
    out = set()
    grams = lambda t: {tuple(t.split()[i : i + 12]) for i in range(len(t.split()) - 11)}
    for d, t in docs:
        for i, s in items:
            if t and s and grams(t) & grams(s):
                out.add((d, i))
    return out


def test_every_shared_window_is_found(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(i, text(rng.randint(5, 40))) for i in range(20)] + [(90, None), (91, ""), (92, items_text := text(30)), (93, items_text)]
    docs = [(i, text(rng.randint(0, 80))) for i in range(60)] + [(500, None), (501, "")]
    for k in range(40):  # planted passages of 11 to 14 words
        i, t = items[rng.randrange(20)]
        w = t.split()
        n = rng.randint(11, 14)
        a = rng.randrange(max(1, len(w) - n + 1))
        docs.append((1000 + k, f"{text(9)} {' '.join(w[a : a + n])} {text(9)}"))
    docs.append((2000, items_text))
    docs.append((2000, items_text))  # a repeated row
    want = brute(docs, items)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, gram string")
    e = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, h string")
    got = L.find_leaks(d, e).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and (2000, 93) in want
    # crowded bit tables let more through and lose nothing
    assert {(r["doc_id"], r["item_id"]) for r in L.find_leaks(d, e, table_bits=6).collect()} == want
    assert L.find_leaks(d.limit(0), e).count() == 0 and L.find_leaks(d, e.limit(0)).count() == 0


def test_disguises(spark):
    item = "Compare how the old river towns settle grain debts once the 364 crown guarantee lapses"
    docs = [
        (1, item.upper()), (2, "> " + item.replace(" settle", "\n> settle")), (3, item.replace("river", "**river**").replace("debts", "dеbts")), (4, item.replace(" ", " ")),
        (5, item.replace("grain", "gra­in")), (6, "&gt; " + item.replace(" once", ", &quot;once&quot;")), (7, item.replace("old", "new")), (8, "cf. " + " ".join(item.split()[:11])),
    ]
    got = L.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string"))
    # a changed word in the fourth place leaves eleven words behind it
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 3, 4, 5, 6]


def test_signatures_find_contained_windows():
    rng = np.random.default_rng(3)
    assert L.bands(L.QUERY) == 1 and all(L.bands(u) >= L.bands(u - 1) for u in range(L.QUERY + 1, L.DOMAIN + 1))
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 10**6, n)) for n in rng.integers(12, 90, 1500)]
    b = L.Shingled(pa.array(texts), L.Hasher())
    row, at, size = b.domains()
    w_row, w_at = b.windows()
    d_sig = np.stack(list(b.signatures(at, size, 20)), 1)
    w_sig = np.stack(list(b.signatures(w_at, np.full(w_at.size, L.QUERY), 20)), 1)
    used = np.arange(20) < L._BANDS[size][:, None]
    # every window lies in the domain that answers for it and shares a band with it
    dom = np.searchsorted(at, w_at, "right") - 1
    assert (row[dom] == w_row).all() and (w_at + L.QUERY <= at[dom] + size[dom]).all()
    hit = ((d_sig[dom] == w_sig) & used[dom]).any(axis=1)
    assert hit.mean() >= 0.9999
    # and hardly any other domain does
    other = ((d_sig[np.roll(dom, 50)] == w_sig) & used[np.roll(dom, 50)]).any(axis=1)[row[np.roll(dom, 50)] != w_row]
    assert other.mean() < 0.001


def test_one_window_in_most_documents(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(i, f"a{i} {passage} b{i}") for i in range(300)], "doc_id bigint, text string")
    items = spark.createDataFrame([(i, f"q{i} {passage} r{i}") for i in range(5)], "item_id bigint, text string")
    got = L.find_leaks(docs, items)
    assert got.count() == 1500 and got.where("n_shared <> 1 or n_item <> 3").count() == 0
