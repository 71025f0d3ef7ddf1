"""Pages made for searchers: pages that are known to be such or not, and edge cases."""

from reelgrid.llm import spam

SCHEMA = "doc_id long, title string, lang string, text string"
PROSE = "The harbour was built of granite in 1801 and widened twice. Its keeper wrote that the roof leaked whenever the wind came from the west. Tickets are for sale online and at the gate, and locals buy a cheap season pass. "
CITIES = ["Aldby", "Borwick", "Carton", "Delham", "Elsund", "Farmouth"]

SPAM = [
    " · ".join(f"replica watches {CITIES[i % 6]}" for i in range(40)),
    "\n".join(f'<a href="http://best-x{i}.example/p/{i}/">car insurance</a><br>' for i in range(20)),
    "\n".join(f"* [http://shop.y{i}.test/ buy cheap sofas {CITIES[i % 6]}]" for i in range(20)),
    ", ".join(f"#buy_sofas_{c}_cheap #sofas{c}online" for c in CITIES),
    "\n".join(f"Acme B{i}7 sofas | XL | SKU {40000 + i * 7} | {i}9.95" for i in range(15)),
    PROSE[:60] + '\n<div style="display:none">' + "; ".join(f"billig Laufschuhe kaufen {c} Angebot" for c in CITIES * 3) + "</div>",
    " ".join(f"купить сумки {c} цена. Скидка сумки онлайн {c}." for c in CITIES * 2),
    " ".join(f"Best w4tch r3p@ir {c} free shipping! Buy w4tch r3p@ir online price." for c in CITIES),
]
GOOD = [
    PROSE * 4,
    PROSE * 3 + "\n".join(f"* [http://archive.z{i}.example/{i} Map of Aldby]" for i in range(4)),
    "Lighthouses\n" + "\n".join(f"Acme B{i}7 | 19{10 + i} | {20 + i} seats | brick" for i in range(30)),
    "{{Navbox\n| name = Aldby\n" + "\n".join(f"| group{i} = mills\n| list{i} = " + " • ".join(f"[[{c}]]" for c in CITIES) for i in range(5)) + "\n}}",
    "'''Aldby''' may refer to:\n" + "\n".join(f"* [[Aldby ({k})]], a {k} in {c}" for k, c in zip(("mill", "weir", "pier", "fort", "inn", "farm"), CITIES)),
    PROSE[:50] + "\n<poem>\n" + "shallow library,\ntimber harbour!\n" * 20 + "</poem>",
    "Timetable Aldby\n" + "\n".join(f"{h:02}:15 {c}" for h, c in zip(range(5, 11), CITIES)),
    "#REDIRECT [[Aldby]]",
    "lol",
    PROSE * 6 + "\n" + " · ".join(f"replica watches {c}" for c in CITIES),
]


def test_pages(spark):
    rows = [(i - 100, "Aldby", "en", t) for i, t in enumerate(SPAM + GOOD)]
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "title", "lang", "text")
    both = spark.createDataFrame(rows, SCHEMA).unionByName(corpus)
    found = sorted(r.doc_id + 100 for r in spam.searcher_pages(both).collect() if r.doc_id < 0)
    assert found == list(range(len(SPAM)))


def test_edges(spark):
    rows = [(1, None, None, SPAM[0]), (1, None, None, SPAM[0]), (2, "", "??", None), (3, "x", "en", ""), (4, "x", "en", " \n "), (5, "x", "en", "word " * 300_000), (6, "x", "en", "#"), (7, "x", "en", "[[" * 20_000)]
    df = spark.createDataFrame([(*r, 0.5, 3) for r in rows], SCHEMA + ", share double, size int")
    assert [r.doc_id for r in spam.searcher_pages(df).collect() if r.doc_id != 5] == [1, 1]
    assert spam.searcher_pages(df.limit(0)).collect() == []


def test_blocks_are_the_text():
    for t in (*SPAM, *GOOD, "x" * 5_000, "a b " * 999, ""):
        assert "".join(spam.blocks(t)) == t


def test_whole_pages_of_the_tables(spark):
    """The candidates lose hardly a page that the exact check alone would find."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = df.select("doc_id", "title", "text").where("text IS NOT NULL").collect()
    alone = {r.doc_id for r in rows if spam.drawing_share(r.text, r.title) > spam.SHARE}
    found = {r.doc_id for r in spam.searcher_pages(df).collect()}
    assert found <= alone and len(found) >= 0.97 * len(alone)


def test_redundant_pages_of_languages_without_trade_words(spark):
    keywords = [
        " ".join(f"Goedkope tassen {c}. Tassen winkel {c}." for c in CITIES * 4),
        " ".join(f"Tanie torby {c}. Sklep torby {c}! Torby {c} tanie." for c in CITIES * 2),
    ]
    good = ["Haha you stink. " * 20, "word. " * 50, PROSE * 4]
    rows = [(i - 100, "Aldby", lang, t) for i, (lang, t) in enumerate([*zip(("nl", "pl"), keywords), *(("en", t) for t in good)])]
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "title", "lang", "text")
    found = sorted(r.doc_id + 100 for r in spam.searcher_pages(spark.createDataFrame(rows, SCHEMA).unionByName(corpus)).collect() if r.doc_id < 0)
    assert found == [0, 1]
    assert not any(spam.drawing_share(t, "Aldby", False) > spam.SHARE for t in keywords)


def test_languages_without_planted_pages(spark):
    import random

    rnd = random.Random(8)
    words = {
        "it": (" ", ["borse", "orologi"], ["prezzo", "offerta", "sconto", "economico", "migliore", "vendita", "spedizione", "recensioni"]),
        "pl": (" ", ["torebki", "zegarki"], ["cena", "tanio", "sklep", "promocja", "najlepsze", "kupon", "dostawa", "opinie"]),
        "zh": ("", ["手表", "皮包"], ["便宜", "价格", "购买", "优惠", "折扣", "最好", "在线", "评论"]),
        "ja": ("", ["時計", "バッグ"], ["格安", "価格", "購入", "通販", "割引", "最高", "送料無料", "口コミ"]),
    }
    rows = []
    for i, (lang, (blank, wares, trade)) in enumerate(words.items()):
        phrases = []
        for _ in range(24):
            p = [rnd.choice(wares), rnd.choice(CITIES), *rnd.sample(trade, rnd.randrange(2, 4))]
            rnd.shuffle(p)
            phrases.append(blank.join(p) + ("。" if blank == "" else ". "))
        rows.append((i - 100, "Aldby", lang, "".join(phrases)))
    rows += [(-50, "Aldby", "it", "Il porto fu costruito in granito nel 1801. Il custode scrisse che il tetto perdeva quando soffiava vento da ovest. I biglietti si vendono online e all'ingresso, e gli abitanti comprano un abbonamento economico."), (-49, "Aldby", "zh", "港口建于1801年，用花岗岩建造。守护人写道，每当西风吹来，屋顶就会漏水。门票在网上和门口出售，当地人购买便宜的季票。")]
    corpus = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "title", "lang", "text")
    found = sorted(r.doc_id for r in spam.searcher_pages(spark.createDataFrame(rows, SCHEMA).unionByName(corpus)).collect() if r.doc_id < 0)
    assert found == [-100, -99, -98, -97]


def test_a_page_has_one_vote(spark):
    """A very long page doesn't change what is usual; repeated rows are judged alike."""
    rows = [(i, "Aldby", "en", t) for i, t in enumerate([SPAM[0], SPAM[7], PROSE * 3, "lorem ipsum " * 100_000])]
    df = spark.createDataFrame(rows + rows, SCHEMA)
    assert [r.doc_id for r in spam.searcher_pages(df).orderBy("doc_id").collect() if r.doc_id < 3] == [0, 0, 1, 1]
