"""Repeated lines, pages in many languages, and the fit of the classifier."""

import numpy as np
import pyarrow as pa
import pytest

from skeinflow.llm import boilerplate as B
from skeinflow.llm import fit as FIT
from skeinflow.llm import frames as FR
from skeinflow.llm import stuffing as S
from tests.conftest import rows
from tests.llm.test_pages import KEYS, PAGE, PROSE

PROSES = {
    "ru": "Старый мост стоял у реки уже больше ста лет, и никто не помнил, кто его построил. Весной вода поднималась почти до самых перил, и тогда дети приходили смотреть на лёд. Осенью здесь было тихо: только рыбаки сидели под ивами. Однажды городской совет решил снести мост, но жители собрали подписи. Теперь по нему ходят пешком, а машины едут по новой дороге.",
    "el": "Το παλιό γεφύρι στεκόταν εκατό χρόνια δίπλα στο ποτάμι και κανείς δεν θυμόταν ποιος το έχτισε. Την άνοιξη το νερό ανέβαινε ως τα κάγκελα, και τα παιδιά έρχονταν να δουν τον πάγο. Το φθινόπωρο ήταν ήσυχα. Μόνο οι ψαράδες κάθονταν κάτω από τις ιτιές. Μια μέρα το συμβούλιο αποφάσισε να το γκρεμίσει, αλλά οι κάτοικοι μάζεψαν υπογραφές.",
    "zh": "老桥在河边已经站了一百多年，没有人记得是谁修的。春天水涨到栏杆边，孩子们跑来看冰。秋天这里很安静，只有钓鱼的人坐在柳树下面。有一天市政府决定把桥拆掉，可是居民们收集了签名。现在人们走路过桥，汽车走新路。我小时候常常和祖父一起去那里，他会讲许多关于洪水的故事。",
    "ko": "오래된 다리는 백 년 넘게 강가에 서 있었고, 누가 지었는지 아무도 기억하지 못했다. 봄이면 물이 난간까지 차올라 아이들이 얼음을 보러 왔다. 가을에는 조용했다. 낚시꾼들만 버드나무 아래에 앉아 있었다. 어느 날 시의회가 다리를 허물기로 했지만 주민들이 서명을 모았다. 이제 사람들은 걸어서 건너고 자동차는 새 길로 다닌다.",
    "fi": "Vanha silta oli seissyt joen rannalla yli sata vuotta, eikä kukaan muistanut, kuka sen oli rakentanut. Keväällä vesi nousi melkein kaiteisiin asti, ja lapset tulivat katsomaan jäitä. Syksyllä täällä oli hiljaista. Vain kalastajat istuivat pajujen alla. Kerran kaupunginvaltuusto päätti purkaa sillan, mutta asukkaat keräsivät nimiä.",
    "tr": "Eski köprü yüz yıldan fazla bir süredir nehrin kıyısında duruyordu ve onu kimin yaptığını kimse hatırlamıyordu. İlkbaharda su neredeyse korkuluklara kadar yükselir, çocuklar buzu görmeye gelirdi. Sonbaharda burası sessizdi. Yalnızca balıkçılar söğütlerin altında otururdu. Bir gün belediye köprüyü yıkmaya karar verdi, ama halk imza topladı.",
    "it": "Il vecchio ponte stava da cento anni vicino al fiume e nessuno ricordava chi lo avesse costruito. In primavera l'acqua saliva quasi fino alla ringhiera e i bambini venivano a vedere il ghiaccio. In autunno era tutto tranquillo. Solo i pescatori sedevano sotto i salici.",
    "pl": "Stary most stał nad rzeką od ponad stu lat i nikt nie pamiętał, kto go zbudował. Wiosną woda podnosiła się prawie do poręczy, a dzieci przychodziły oglądać lód. Jesienią było tu cicho. Tylko wędkarze siedzieli pod wierzbami.",
    "hi": "पुराना पुल सौ साल से नदी के किनारे खड़ा था और किसी को याद नहीं था कि उसे किसने बनाया। वसंत में पानी लगभग रेलिंग तक चढ़ जाता था और बच्चे बर्फ देखने आते थे। पतझड़ में यहाँ शांति रहती थी। केवल मछुआरे पेड़ों के नीचे बैठते थे।",
    "ar": "كان الجسر القديم قائما على ضفة النهر منذ أكثر من مئة عام، ولم يكن أحد يتذكر من بناه. في الربيع يرتفع الماء حتى الحاجز، ويأتي الأطفال لرؤية الجليد. في الخريف كان المكان هادئا. كان الصيادون وحدهم يجلسون تحت الأشجار.",
    "ja": "古い橋は百年以上も川のそばに立っていて、誰が建てたのか誰も覚えていなかった。春になると水が手すりの近くまで上がり、子どもたちが氷を見に来た。秋は静かだった。釣り人だけが柳の下に座っていた。ある日、市議会は橋を取り壊すことにしたが、住民が署名を集めた。",
    "th": "สะพานเก่ายืนอยู่ริมแม่น้ำมานานกว่าร้อยปี และไม่มีใครจำได้ว่าใครสร้าง ในฤดูใบไม้ผลิน้ำขึ้นเกือบถึงราวสะพาน เด็ก ๆ มาดูน้ำแข็ง ในฤดูใบไม้ร่วงที่นี่เงียบสงบ มีแต่คนตกปลานั่งอยู่ใต้ต้นหลิว",
}
KEYWORDS = {
    'ru': 'купить сапоги дёшево, сапоги скидка, лучшие сапоги, сапоги купить, новые сапоги, сапоги оптом, ',
    'zh': '便宜靴子 买靴子 靴子打折 最好靴子 新靴子 靴子批发 ',
    'ko': '부츠 할인, 싼 부츠, 부츠 사기, 최고 부츠, 새 부츠, ',
    'el': 'μπότες φθηνές, αγορά μπότες, μπότες προσφορά, καλύτερες μπότες, ',
    'fi': 'halvat saappaat, osta saappaat, saappaat ale, parhaat saappaat, uudet saappaat, ',
}


@pytest.mark.parametrize("lang", PROSES)
def test_prose_is_not_stuffed(lang):
    text = PROSES[lang]
    for page in (text, f"<p>{text}</p>", text.replace(". ", ".\n").replace("。", "。\n"), f"<p>{text}</p>\n<p>{text}</p>"):
        assert S.stuffed_share(page) < S.MOST


@pytest.mark.parametrize("lang", KEYWORDS)
def test_keywords_are_stuffed(lang):
    assert S.stuffed_share(KEYWORDS[lang] * 12) == 1.0
    assert S.stuffed_share(f"<p>{PROSES[lang]}</p>\n<div style='display:none'>{KEYWORDS[lang] * 30}</div>") > S.MOST


def test_few_words_are_measured():
    assert S.stuffed_share("boots " * 11) == 1.0
    assert S.stuffed_share("Not found.") == 0.0 and S.stuffed_share("!!!") == 0.0


def by_hand(pages, urls):
    """Bodies of each piece, in the collection and in its host."""
    number = {}
    for page, url in zip(pages, urls, strict=True):
        one = FR.Pieces(pa.array([page]), pa.array([url]))
        for h in set(one.keys().tolist()):
            number[h] = number.get(h, 0) + 1
    return number


PAGES = [f"<ul><li>Home</li><li>About us</li></ul>\n<p>{w} of the bridge</p>\n© {2000 + i} Site | Imprint\n\n" for i, w in enumerate("abcdefgh")] + ["", "one\nHome"]
URLS = [f"http://h{i % 2}.example/{i}" for i in range(9)] + [None]


def test_counts():
    want = {h: n for h, n in by_hand(PAGES, URLS).items() if n >= 3}
    counts = FR.Counts.of(PAGES, URLS)
    assert dict(zip(counts.keys.tolist(), counts.bodies.tolist(), strict=True)) == want
    got = FR.repetition(pa.array(PAGES), pa.array(URLS, pa.string()), counts)
    assert [len(r) for r in got] == [5] * 8 + [1, 2]
    first = got[0]
    assert first[0, 0] == 1 and first[1, 0] == 0 and first[2].tolist() == [1, 1, 0] and first[3, 0] == 0
    assert got[9][:, 0].tolist() == [0, 1]
    assert FR.repetition(pa.array([], pa.string()), pa.array([], pa.string()), counts) == []
    assert FR.repetition(pa.array(["a\nb"]), pa.array([None], pa.string()), FR.Counts.of([], []))[0].tolist() == [[0, 0, 0]] * 2
    sliced = FR.repetition(pa.array(PAGES).slice(3, 2), pa.array(URLS, pa.string()).slice(3, 2), counts)
    assert all((a == b).all() for a, b in zip(sliced, got[3:5], strict=True))


def test_counted(spark):
    df = spark.createDataFrame(list(zip(PAGES * 2 + [None, " "], URLS * 2 + ["u", "u"], strict=True)), "page string, url string")
    bodies = FR.distinct_bodies(df)
    assert bodies.count() == 9
    some = [(p, u) for p, u in zip(PAGES, URLS, strict=True) if p]
    want = {h: n for h, n in by_hand(*zip(*some, strict=True)).items() if n >= 3}
    assert dict(tuple(r) for r in FR.counted(bodies).collect()) == want
    assert FR.counted(bodies.limit(0)).count() == 0


def test_both_ways_to_the_counts(spark):
    """Counts sent as a table and joined by their hash give the same rows."""
    pages = [(i, f"Home | Help | About us\nWe use cookies to make this site work.\n\n{PROSE.replace('bridge', w)}\n{(KEYS.replace('boots', w) + ' ') * (i % 2 * 4)}\n© 2020 Site", f"http://a.example/{i}") for i, w in enumerate("tower mill river path boat lamp".split())]
    df = spark.createDataFrame([*pages, (90, None, None), (91, " ", "u"), pages[0]], "page_id long, page string, url string")
    assert rows(S.stuffed_shares(df)) == rows(S.stuffed_shares(df, most_sent=0))
    shares = {r["page_id"]: r["share"] for r in S.stuffed_shares(df).collect()}
    assert shares[0] == 0 and shares[1] > S.MOST and shares[90] is None and shares[91] is None
    assert rows(B.main_bodies(df)) == rows(B.main_bodies(df, most_sent=0))


def test_pieces_that_few_bodies_share_are_not_sent(spark):
    """Pieces of three bodies each, more with every body, don't count against the number that is sent; rows are the same."""
    word = lambda i: "".join("bdfglmnprst"[i // 11**k % 11] + "aeiou"[(i + k) % 5] for k in range(4))
    pages = [(i, f"Home | Help | About us\n{PROSE.replace('bridge', word(i))}\n" + "\n".join(f"{word(100 + i // 3 * 9 + j)} of old" for j in range(9)) + f"\n{(KEYS.replace('boots', word(i)) + ' ') * (i % 2 * 4)}", f"http://h{i % 2}.example/{i}") for i in range(1200)]
    df = spark.createDataFrame(pages, "page_id long, page string, url string")
    sent = S.stuffed_shares(df, most_sent=100)
    assert "Join" not in sent._jdf.queryExecution().optimizedPlan().toString()
    counts = FR.counted_by_host(FR.distinct_bodies(df))
    few = {r["h"]: r["bodies"] for r in FR.deciding(counts, S.REPEATED).collect()}
    every = {r["h"]: r["bodies"] for r in FR.counted(FR.distinct_bodies(df)).collect()}
    assert len(few) < 100 < 3600 <= len(every) and few.items() <= every.items()
    columns = [pa.array([p[k] for p in pages]) for k in (1, 2)]
    for a, b in zip(*(FR.repetition(*columns, FR.Counts(*(np.array(list(x)) for x in (c.keys(), c.values())))) for c in (every, few)), strict=True):
        assert ((a >= S.REPEATED) == (b >= S.REPEATED)).all()
    assert rows(sent) == rows(S.stuffed_shares(df)) == rows(S.stuffed_shares(df, most_sent=0))
    assert FR.deciding(FR.counted_by_host(FR.distinct_bodies(df.limit(0))), S.REPEATED).count() == 0


def test_joined_counts_are_read_for_many_pages_at_once(monkeypatch):
    keys = [FR.Pieces(pa.array([p]), pa.array([u], pa.string())).keys() for p, u in zip(PAGES, URLS, strict=True)]
    counts = FR.Counts.of(PAGES, URLS)
    own = [[int(h) for h in k if h in counts.keys] for k in keys]
    bodies = [[int(counts(np.array([h]))[0]) for h in k] or None for k in own]
    arrays = [pa.array(range(len(PAGES))), pa.array(PAGES), pa.array(URLS, pa.string()), *(pa.array([x or None for x in y], pa.list_(pa.int64())) for y in (own, bodies))]
    batch = pa.RecordBatch.from_arrays(arrays, names=["k", "page", "url", "hs", "ns"])
    want = FR.repetition(batch.column(1), batch.column(2), counts)
    calls = []
    monkeypatch.setattr(FR, "repetition", lambda *a, f=FR.repetition: calls.append(1) or f(*a))
    for part, expected in ((batch, want), (batch.slice(3, 5), want[3:8])):
        assert all((a == b).all() for a, b in zip(FR.SentCounts.reader(None)(part), expected, strict=True))
    assert len(calls) == 2


def test_fit_learns_what_repeats():
    """On pages of one site whose container has a name, the fit tells repeated lines from others in any container."""
    rnd = np.random.default_rng(3)
    word = lambda: "".join(rnd.choice(list("bdfglmnprst")) + rnd.choice(list("aeiou")) for _ in range(3))
    sentence = lambda: " ".join(word() for _ in range(7)) + "."
    pages = []
    for _ in range(40):
        page = PAGE.replace('class="zz1"', 'class="main-content"')
        for x in ("The bridge was closed in spring. Nobody knew why, and nobody asked. It was opened later.", "four old stones", "It stands there still, as it did. People walk over it every day.", "The tower fell down.", "The bridge was closed"):
            page = page.replace(x, sentence())
        pages.append(page)
    weights = FIT.fit(pages, ["http://a.example/x"] * 40)
    assert len(weights[True]) == len(weights[False]) == len(B.FEATURES)
    at = B.FEATURES.index("repeated")
    assert weights[True][at] < 0 and weights[False][at] < 0
