"""p3, p4, p5, p6, p7, p8, p9, p10 on small fixtures, against brute force or a round trip."""

import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiflow.llm import p3_splitting as p3
from lexiflow.llm import p4_scan_noise as p4
from lexiflow.llm import p5_truncation as p5
from lexiflow.llm import p6_repeated_lines as p6
from lexiflow.llm import p7_broken_pairs as p7
from lexiflow.llm import p8_evaluation_leaks as p8
from lexiflow.llm import p9_mixing as p9
from lexiflow.llm import p10_residue as p10
from lexiflow.llm.common import words


# p3 ------------------------------------------------------------------------------------------------


def test_splitting_round_trip(spark):
    rnd = random.Random(2)
    ends = [". ", "! ", "?» ", "… ", "\n\n", "\n", " ", ", ", " стр. 5 ", " т. е. "]
    texts = ["".join("слово" * rnd.randint(1, 4) + rnd.choice(ends) for _ in range(rnd.randint(1, 300))) for _ in range(60)]
    texts += ["а" * 5000, "😀" * 700, "короткий", "x" * 500 + ". " + "y" * 900]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("piece", F.lit(1))
    got = {}
    for r in p3.split_pieces(df, "id", "text", limit=500, overlap=80).orderBy("id", "piece_no").collect():
        got.setdefault(r.id, []).append(r)
    boundary = re.compile(r"\n[ \t\r\f]*\n|(?:[!?…]|(?<![^\W\d_])(?:(?<=\d)|)\.|\.)[»”\"')\]]*(?=\s|$)")
    for i, text in enumerate(texts):
        rows = got[i]
        assert "".join(r.piece[len(r.piece) - r.new_chars :] for r in rows) == text
        assert all(len(r.piece) <= 500 for r in rows)
        at = 0
        for n, r in enumerate(rows):
            assert r.piece == text[max(0, at - 80) : at + r.new_chars] if n else r.piece == text[: r.new_chars]
            at += r.new_chars
        assert not rows[-1].forced
    assert boundary and all(r.forced for r in got[60][:-1]) and len(got[62]) == 1


def test_splitting_boundaries_and_edges(spark):
    a = "Предложение одно. " * 40
    rows = [(1, a), (2, ("без точки " * 60)), (3, None), (4, ""), (5, "см. стр. 5, им. Петрова, т. е. так, " * 20), (1, a)]
    df = spark.createDataFrame(rows, "id long, text string")
    forced = {r.id for r in p3.forced_items(df, "id", "text", limit=300, overlap=40).collect()}
    assert forced == {2, 5}
    assert p3.split_pieces(df.where("id in (3, 4)"), "id", "text").collect() == []
    with pytest.raises(ValueError):
        p3.split_pieces(df, "id", "text", limit=300, overlap=200)


def test_splitting_finds_a_boundary_anywhere_in_reach(spark):
    """Whatever the offset of the only sentence end in the room, the cut is made there."""
    for mark in (".", "!»", "?”)", "…»”)]"):
        rows = [(at, "я" * (at - len(mark)) + mark + " " + "я" * 400) for at in (100, 190, 215, *range(218, 221))]
        df = spark.createDataFrame([*rows, (221, "я" * (221 - len(mark)) + mark + " " + "я" * 400)], "id long, text string")
        first = {r.id: r for r in p3.split_pieces(df, "id", "text", limit=260, overlap=40).where("piece_no = 0").collect()}
        assert all(first[at].new_chars == at and not first[at].forced for at, _ in rows)
        assert first[221].forced and first[221].new_chars == 220


# p4 ------------------------------------------------------------------------------------------------


def scan_table(spark):
    sentences = ["Крестьянское хозяйство медленно раскрывает общественную природу труда.", "Рыночная организация постепенно укрепляет городскую промышленность.", "Научно-производственная мера сохраняет общественно-трудовую основу."]
    clean = [(f"c{i}", "\n".join(sentences)) for i in range(30)]
    noisy = [
        ("hyphen", "Крестьянское хозяй-\nство медленно раскрывает природу."),
        ("own", "Вся научно-\nпроизводственная мера сохраняет основу."),
        ("mixed", "Крестьянское хо3яйство медленно раскрывает."),
        ("letters", "Крестьянское хозяйсгво медленно раскрывает."),
        ("pages", "Рыночная организация постепенно\n- 12 -\nПИСЬМА ИЗ УЕЗДА\nукрепляет промышленность."),
        ("pages2", "Рыночная организация постепенно\nПИСЬМА ИЗ УЕ3ДА   13\nукрепляет промышленность."),
        ("pages3", "Рыночная организация\n[14]\nП И С Ь М А  И З  У Е З Д А\nукрепляет."),
        ("pages4", "Рыночная организация\nПисьма из уезда 15\nукрепляет."),
        ("table", "1895 | тенденция | 19,7 | 6668\nВ 1905-м, по счёту XIX-го века, термин ещё не звучал."),
        ("null", None),
        ("empty", ""),
    ]
    return spark.createDataFrame([*clean, *noisy], "id string, text string").withColumn("key", F.lit(0))


def test_scan_noise(spark):
    got = {}
    for r in p4.scan_noise(scan_table(spark), "id", "text").collect():
        got.setdefault(r.id, set()).add(r.noise)
    assert got == {"hyphen": {"hyphen"}, "mixed": {"misread"}, "letters": {"misread"}, "pages": {"header", "pageno"}, "pages2": {"header", "pageno"}, "pages3": {"header", "pageno"}, "pages4": {"header", "pageno"}}


def test_scan_repair(spark):
    got = {r.id: r for r in p4.repaired(scan_table(spark), "id", "text").collect()}
    assert len(got) == 41
    assert got["hyphen"].repaired == "Крестьянское хозяйство медленно раскрывает природу."
    assert got["own"].repaired == got["own"].text and not got["own"].changed
    assert got["mixed"].repaired == "Крестьянское хозяйство медленно раскрывает."
    assert got["letters"].repaired == "Крестьянское хозяйство медленно раскрывает."
    assert got["pages2"].repaired == "Рыночная организация постепенно укрепляет промышленность."
    assert got["c1"].repaired == got["c1"].text and got["null"].repaired is None
    assert p4.scan_noise(scan_table(spark).where("false"), "id", "text").collect() == []


def volumes(spark, n: int, page):
    rnd = random.Random(3)
    line = lambda k: " ".join(rnd.choice("труд капитал власть рынок завод школа кризис бюджет город уезд".split()) for _ in range(k))
    heads = ["ТЕТРАДЬ " + "".join(rnd.choice("АБВГДЕЖЗИКЛМН") for _ in range(9)) for _ in range(n)]
    return spark.createDataFrame([(f"{v}_{k}", v, page(line, heads[v], k)) for v in range(n) for k in range(4)], "id string, volume int, text string")


@pytest.mark.parametrize(
    ("page", "noise"),
    [
        (lambda line, head, k: f"{line(9)}\n{head}\n{line(9)}.", {"header"}),
        (lambda line, head, k: f"{line(9)}.\n{head}\n{line(9).capitalize()}.", {"header"}),
        (lambda line, head, k: f"{line(9)}.\n{head}   {k + 80}\n{line(9).capitalize()}.", {"header", "pageno"}),
        (lambda line, head, k: f"{line(9)}.\n\n— {k + 80} —\n{head}\n\n{line(9).capitalize()}.", {"header", "pageno"}),
    ],
)
def test_headers_belong_to_volumes(spark, page, noise):
    """However many volumes there are, each one's header is found."""
    found = p4.scan_noise(volumes(spark, 90, page), "id", "text", "volume").groupBy("noise").count().collect()
    assert {r["noise"]: r["count"] for r in found} == dict.fromkeys(noise, 360)


def test_numbers_and_lines_of_clean_text_stay(spark):
    table = "Таблица годов.\n1905\nурожай 12\n1906\nурожай 14\nКонец таблицы."
    account = "Счёт уезда за год составлен верно.\n1905\n1906\nПриход 300\n12\nРасход 200\nИтого 500"
    copies = "Сегодня утром встретил его\nВладимир Петрович Сомов\nсказал и ушёл домой."
    rows = [("table", 1, table), ("account", 1, account), *[(f"copy{i}", 2, copies) for i in range(5)], ("null", None, None), ("empty", 1, "")]
    df = spark.createDataFrame(rows, "id string, volume int, text string").withColumn("lines", F.lit(0))
    assert p4.scan_noise(df, "id", "text", "volume").collect() == []
    assert all(r.repaired == r.text for r in p4.repaired(df, "id", "text", "volume").collect())


def test_page_numbers_rise():
    page = ["Первая мысль автора верна.", "Вторая мысль автора верна.", "Третья мысль автора верна.", "Четвёртая мысль автора верна."]
    lines = [*page, "17", *page, "18", *page]
    assert p4.page_numbers(lines) == {4, 9}
    assert p4.page_numbers([*page, "17", *page, "45", *page]) == set()
    assert p4.page_numbers(["Начало фразы", "17", "и её конец."]) == {1}


def test_misread_at_a_word_end(spark):
    df = spark.createDataFrame([("end", "Крупный капита/i растёт."), ("start", "Крупный /iесной рынок."), ("name", "Покупка Россия/iPhone и и/или прочее.")], "id string, text string")
    assert {tuple(r) for r in p4.scan_noise(df, "id", "text").collect()} == {("end", "misread"), ("start", "misread")}
    assert {r.id: r.repaired for r in p4.repaired(df, "id", "text").collect()}["end"] == "Крупный капитал растёт."


def broadcast_rows(df):
    """The rows of every table that was broadcast for a result, the largest first."""
    df.collect()
    rows, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            rows.append(node.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return sorted(rows, reverse=True)


def test_words_of_all_texts_are_never_broadcast(spark):
    """What the driver holds follows the rare words and the headers found, not all words of all texts."""
    rnd = random.Random(4)
    known = sorted({"".join(rnd.choice("абвгдежзик") for _ in range(7)) for _ in range(40)})
    rows = [(i, 0, " ".join(known)) for i in range(400)] + [(400, 0, "инструмент " * 3), *((i, 0, "инструмент") for i in range(401, 420)), (420, 0, "ииструмент")]
    df = spark.createDataFrame(rows, "id long, volume long, text string")
    found = p4.scan_noise(df, "id", "text", "volume")
    assert broadcast_rows(found)[0] < 200 and {tuple(r) for r in found.collect()} == {(420, "misread")}
    fixed = p4.repaired(df, "id", "text", "volume")
    assert broadcast_rows(fixed)[0] < 200 and [r.repaired for r in fixed.where("changed").collect()] == ["инструмент"]

    pages = [(str(i), 0, f"Первая строка {i} текста\nтекст идёт\nСборник Работ Автора\nи идёт дальше {i}.") for i in range(300)]
    pages += [("last", 0, "Первая строка\nтекст идёт\nСборник Рабт Автора\nи идёт дальше.")]
    headers = p4.header_lines(spark.createDataFrame(pages, "key string, volume long, text string"))
    assert broadcast_rows(headers)[0] < 200 and {(r.key, *r.lines) for r in headers.collect()} == {(k, 2) for k, _, _ in pages}


# p5 ------------------------------------------------------------------------------------------------


def test_truncation(spark):
    whole = "Крупный завод помогает городу. Новая школа служит общему делу."
    rows = [(i, whole + " Работа продолжается." * (i % 4), "s") for i in range(40)]
    rows += [(100 + i, (whole * 3)[:77] if i % 2 else (whole * 3)[:78], "s") for i in range(24)]
    cases = {
        200: "Крупный завод помогает гор", 201: "Новая школа служит общему делу...", 202: "Новая школа служит общему дел...", 203: None, 204: " — ", 205: "<br/>", 206: whole + "\n• общему делу", 207: whole + "\n#работа #школа",
        208: "См. на стр.", 209: whole + "\nПодробнее: https://a.example/b/1", 210: "Крупный завод, что", 211: "Крупный завод <a hre", 212: whole + "\n(по материалам редакции)", 213: whole + "\n— Петров А. Б.", 214: "«Новая школа служит делу.»", 215: "N/A",
    }
    rows += [(i, t, "s") for i, t in cases.items()] + [(200, cases[200], "s")]
    df = spark.createDataFrame(rows, "id long, text string, source string").withColumn("limit", F.lit(None))
    got = {r.id: r for r in p5.truncation(df, "id", "text", "source").collect()}
    cut = {i for i, r in got.items() if r.truncated and i >= 200}
    assert cut == {200, 202, 208, 210, 211}
    assert all(r.truncated for i, r in got.items() if 100 <= i < 200) and not any(r.truncated for i, r in got.items() if i < 40)
    assert p5.truncation(df.where("false"), "id", "text", "source").collect() == []


def test_posterior_decides_at_limits():
    """The same doubtful ending is cut at a limit and whole off the limits, and the shares come from the data."""
    rows = [(0, "finished", "ends", 0.0, 9000), (4, "finished", "ends", 0.98, 150), (4, "open", "unknown", 0.98, 600), (4, "open", "inside", 0.98, 300), (4, "structured", "rare", 0.98, 30), (0, "structured", "ends", 0.0, 250), (0, "structured", "rare", 0.0, 60)]
    got = p5.cut_posteriors(p5.pd.DataFrame(rows, columns=["level", "mark", "word", "at", "n"])).set_index(["level", "mark", "word"])["posterior"]
    assert got[4, "open", "unknown"] > 0.99 and got[0, "finished", "ends"] == got[4, "finished", "ends"] == 0
    assert got[4, "structured", "rare"] > 0.5 > got[0, "structured", "rare"]


def test_declared_limits(spark):
    df = spark.createDataFrame([(i, " ".join(["слово"] * (20 if i % 2 else 5 + i % 9)), "m", 20) for i in range(200)], "id long, text string, source string, most int")
    rows = p5.truncation(df, "id", "text", "source", limit_col="most")
    assert all(r.at_limit > 0.8 for r in rows.where("id % 2 = 1").collect())


# p6 ------------------------------------------------------------------------------------------------


def test_repeated_lines_against_brute_force(spark):
    rnd = random.Random(5)
    notices = ["Подпишитесь на нас: {}", "Поделиться", "Все права защищены, {}"]
    rows = []
    for i in range(200):
        lines = [f"Новость номер {rnd.choice('абвгдежз')}{'а' * (i % 50)}", "", "123"]
        for n in notices:
            if rnd.random() < 0.3:
                lines.insert(rnd.randint(0, len(lines)), n.format(i))
        rows.append((f"n{i}", "\n".join(lines), rnd.choice(["x", "x", "y", None])))
    rows += rows[:20] + [("null", None, "x"), (None, "Поделиться", "x")]
    df = spark.createDataFrame(rows, "id string, text string, source string").withColumn("line_no", F.lit("clash"))
    got = {(r.id, r.line_no) for r in p6.repeated_lines(df, "id", "text", "source").collect()}
    holders, items, all_ = {}, {}, []
    for i, t, s in rows:
        if i is None or s is None:
            continue
        items.setdefault(s, set()).add(i)
        for n, line in enumerate((t or "").split("\n")):
            if key := "".join(c for c in line.lower() if c.isalpha()):
                holders.setdefault((s, key), set()).add(i)
                all_.append((i, n, s, key))
    want = {(i, n) for i, n, s, k in all_ if len(holders[s, k]) >= 5 and len(holders[s, k]) >= 0.05 * len(items[s]) - 1e-9}
    assert got == want and want
    clean = p6.without_repeated_lines(df, "id", "text", "source").collect()
    assert len(clean) == len(rows) and not any("Поделиться" in (r.text or "") for r in clean if r.id and r.source)
    assert p6.repeated_lines(df.where("false"), "id", "text", "source").collect() == []


def test_blocks_join_neighbouring_lines(spark):
    df = spark.createDataFrame([(i, f"уникальная {'я' * i}\nпервая строка\nвторая строка\nиная {'ю' * i}\nтретья строка", "s") for i in range(10)], "id long, text string, source string")
    blocks = {r.sample: r.block for r in p6.boilerplate_blocks(df, "id", "text", "source").collect()}
    assert blocks["первая строка"] == blocks["вторая строка"] != blocks["третья строка"]


# p7 ------------------------------------------------------------------------------------------------


def test_broken_pairs(spark):
    q = "Завод в городе открыл новую линию. Жители обсуждают большую перемену в работе."
    good = "Перемены усиливают хозяйственную основу труда и помогают общему делу."
    kinds = {"empty": ["", None, "—", "N/A", "<br/>"], "refusal": ["К сожалению, я не могу ответить на такой запрос.", "Я воздержусь от оценки этого сообщения. Уточните формулировку."], "copy": [q, q.upper(), "Вопрос: " + q], "language": ["It is said that older markets of the towns follow the workers."], "truncated": ["Перемены усиливают хозяйственную осн"]}
    sound = [good, "Невозможно ответить на вопрос о деле, не назвав общую причину труда.", "В сообщении сказано: «Завод в городе», и за этим стоит общее дело труда."]
    rows = [(f"{k}{i}{n}", q, a, "open" if k == "truncated" else "finished" if a and a[-1:] == "." else "nothing", "unknown" if k == "truncated" else "ends", 0.0) for k, v in kinds.items() for i, a in enumerate(v) for n in range(8)]
    rows += [(f"good{i}{n}", q, a, "finished", "ends", 0.0) for i, a in enumerate(sound) for n in range(60)] + [("noq", None, good, "finished", "ends", 0.0)]
    pairs = spark.createDataFrame(rows, "pair_id string, question string, answer string, mark string, last_word string, at_limit double").withColumn("pair_kind", F.lit("t"))
    labelled = spark.createDataFrame([("Перемены усиливают хозяйственную основу труда и помогают делу. " * 10, "ru"), ("It is said that markets of the towns follow older workers. " * 10, "en"), (None, "ru"), ("x", None)], "text string, lang string")
    got = {r.pair_id: r.defect for r in p7.broken_pairs(pairs, labelled).collect()}
    assert all(got.pop(r[0], None) == re.match(r"[a-z]+", r[0])[0] for r in rows if not r[0].startswith(("good", "noq")))
    assert got == {}


def test_language_model_reads_whole_texts(spark):
    q, good, foreign = "Завод в городе открыл новую линию.", "Перемены усиливают хозяйственную основу труда и помогают общему делу.", "Les nouvelles machines de la ville changent le travail des ouvriers."
    french, english = "Les nouvelles machines changent le travail des ouvriers de la ville. ", "The new machines of the town change the work of the people. "
    rows = [(f"bad{i}", french, english, "finished", "ends", 0.0) for i in range(8)] + [(f"good{i}", french, foreign, "finished", "ends", 0.0) for i in range(60)] + [(f"ru{i}", q, good, "finished", "ends", 0.0) for i in range(60)]
    pairs = spark.createDataFrame(rows, "pair_id string, question string, answer string, mark string, last_word string, at_limit double").withColumn("pair_kind", F.lit("t"))
    head = "12 34 56 78 " * 40
    labelled = spark.createDataFrame([(head + french * 10, "fr"), (head + english * 10, "en"), (head + good * 10, "ru")], "text string, lang string")
    assert {(r.pair_id[:3], r.defect) for r in p7.broken_pairs(pairs, labelled).collect()} == {("bad", "language")}


def test_language_model_and_cutoffs_have_all_rows(spark):
    texts = [(f"жук {'абвгдежзик'[i % 10]}{'лмнопрстуф'[i // 10 % 10]}{'хцчшщъыьэю'[i // 100 % 10]} {'абвгдежзик'[i // 1000]}", "ru") for i in range(3000)] + [(None, "ru"), ("x", None)]
    counts = p7.trigram_counts(spark.createDataFrame(texts, "text string, lang string").repartition(7))
    want = Counter(g for t, lang in texts if t and lang for g in p7.LanguageModel._grams(t))
    assert counts == {"ru": want} and want["жук"] == 3000

    q, good = "Завод в городе открыл новую линию.", "Перемены усиливают хозяйственную основу труда и помогают общему делу."
    rows = [(f"good{i}", q, good, "finished", "ends", 0.0) for i in range(700)]
    pairs = spark.createDataFrame(rows, "pair_id string, question string, answer string, mark string, last_word string, at_limit double").withColumn("pair_kind", F.lit("t"))
    labelled = spark.createDataFrame([(good * 10, "ru"), ("The new machines of the town change the work of the people. " * 10, "en")], "text string, lang string")
    planted = {r.defect: r.planted for r in p7.agreement(pairs.repartition(5), labelled).collect()}
    assert planted == dict.fromkeys(p7.DEFECTS, 700)


# p8 ------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=25), min_size=1, max_size=4), st.lists(st.sampled_from("abcde"), max_size=60), st.integers(2, 5))
def test_automaton_marks_what_brute_force_marks(items, text, least):
    a = p8.SuffixAutomaton(list(enumerate(items)))
    marks, spans = a.covered(text, least)
    grams = {tuple(text[i : i + least]) for i in range(len(text) - least + 1)}
    for n, item in enumerate(items):
        want = {p for i in range(len(item) - least + 1) if tuple(item[i : i + least]) in grams for p in range(i, i + least)}
        assert marks.get(n, set()) == want
    all_ = {tuple(x[i : i + least]) for x in items for i in range(len(x) - least + 1)}
    held = {p for i in range(len(text) - least + 1) if tuple(text[i : i + least]) in all_ for p in range(i, i + least)}
    assert {p for a, b in spans for p in range(a, b + 1)} == held


def test_leaks(spark):
    item = "раз два три четыре пять шесть семь восемь девять десять ёлка"
    items = spark.createDataFrame([(1, item), (2, item), (3, "слишком мало слов"), (4, None), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Начало. {item.upper().replace('Ё', 'Е')}! Конец"), (2, "раз два три, четыре: пять шесть семь восемь прочее"), (3, "раз два три четыре пять шесть семь"), (4, None), (5, ""), (1, f"Начало. {item.upper().replace('Ё', 'Е')}! Конец")], "doc_id long, text string").withColumn("item_id", F.lit(9))
    for block in (1_000_000, 12):
        got = {(r.doc_id, r.item_id): round(r.cover, 3) for r in p8.leaked_items(docs, items, "doc_id", "text", "item_id", "text", block_words=block).collect()}
        assert got == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): round(8 / 11, 3), (2, 2): round(8 / 11, 3)}
    clean = {r.doc_id: r.text for r in p8.without_leaks(docs, items, "doc_id", "text", "item_id", "text").collect()}
    assert clean == {1: "Начало. ! Конец", 2: " прочее", 3: "раз два три четыре пять шесть семь", 4: None, 5: ""}


# p9 ------------------------------------------------------------------------------------------------


def test_service_time():
    caps = {"a": (0.5, 100.0), "b": (0.5, None)}
    assert p9.service_time(caps, None) == 200.0
    assert p9.service_time(caps, 100) == 100.0 and p9.service_time(caps, 300) == 400.0
    assert p9.service_time({}, 10) == 0.0


def test_mixture(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(["слово"] * rnd.randint(5, 40)), s) for i, s in enumerate(["big"] * 700 + ["mid"] * 150 + ["small"] * 20 + ["other"] * 30 + [None] * 5)] + [(999, None, "big"), (998, "", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, None), ("small", 0.2, 3), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    mix, report = p9.mixture(docs, targets, "doc_id", "text", "source")
    got = {r.source: r for r in report.collect()}
    drawn = mix.collect()
    assert [r.finish for r in drawn] == sorted(r.finish for r in drawn)
    for s, want in (("big", 4 / 9), ("mid", 3 / 9), ("small", 2 / 9)):
        assert abs(got[s].share - want) < 0.03
    assert got["none"].documents == 0 and got["small"].passes == 3
    times = {}
    for r in drawn:
        times[r.id] = times.get(r.id, 0) + 1
    assert max(times[i] for i in times if rows[i][2] == "small") <= 3 and all(times[i] == 1 for i in times if rows[i][2] == "big")
    _, full = p9.mixture(docs, targets, "doc_id", "text", "source", of_corpus=1.0)
    full = {r.source: r for r in full.collect()}
    assert full["small"].share < got["small"].share and sum(r.tokens for r in full.values()) > sum(r.tokens for r in got.values())
    empty, r = p9.mixture(docs.where("false"), targets, "doc_id", "text", "source")
    assert empty.collect() == [] and all(x.documents == 0 for x in r.collect())


# p10 -----------------------------------------------------------------------------------------------

RESIDUE = {
    "placeholder": ["Уважаемый {{ имя }}, пишем вам.", "Дата: ${date}.", "Опубликовано %author_name% вчера", "[ВСТАВИТЬ: ФИО] родился", "<ВАШЕ имя> пишет", "&lt;тема&gt; важна", "{% block x %} да", "<%= body %>", "[[title]]", "@@city@@"],
    "filler": ["Lorem ipsum dolor talque namus.", "рыба рыба рыба рыба рыба", "asdf qwer тест", "Здесь будет текст раздела.", "Sample paragraph. Replace this text with your own."],
    "error_page": ["404 — Страница не найдена.", "HTTP 502\nBad gateway. The upstream host did not answer.", "Сервис временно недоступен. Вернитесь на главную.", "Accès refusé (erreur 403). Retour à l’accueil."],
    "script_notice": ["Для работы сайта включите JavaScript.", "<noscript>Please enable JavaScript to view this page.</noscript>", "В вашем браузере отключены сценарии, поэтому содержимое не показано."],
}
PROSE = ["Докладчик вспомнил надпись «страница не найдена», и зал засмеялся.", "Язык JavaScript и латынь учат одинаково: по примерам.", "Множество {A, B, C} и знак % здесь.", "Сноска {137} и [12].", "__важно__ для рубрики", "цена = $5, скидка = 10 %", "Слова «текст будет позже» он поставил эпиграфом к сборнику о лени.", "Страница не найдена в описи: лист 7 утрачен ещё до переплёта.", "", "Она спорила о том, должен ли сайт читаться без скриптов, и отвечала: должен."]


def test_residue(spark):
    long = "Крупный завод помогает городу и всей округе. " * 30
    rows = [(f"{k}{i}", t) for k, v in RESIDUE.items() for i, t in enumerate(v)] + [(f"in_{k}", f"{long}\n\n{v[0]}\n\n{long}") for k, v in RESIDUE.items()] + [(f"prose{i}", t) for i, t in enumerate(PROSE)] + [("null", None), ("filler0", RESIDUE["filler"][0])]
    got = {r.id: r for r in p10.residue(spark.createDataFrame(rows, "id string, text string").withColumn("residue", F.lit(1)), "id", "text").collect()}
    want = {i: re.sub(r"^in_|\d+$", "", i) for i, _ in rows if not i.startswith(("prose", "null"))}
    assert {i: r.residue for i, r in got.items()} == want
    assert all(r.coverage < 0.1 for i, r in got.items() if i.startswith("in_"))
    assert p10.residue(spark.createDataFrame([("a", PROSE[0]), ("b", None)], "id string, text string"), "id", "text").collect() == []


FIELDS = ["[имя — заполнить] родился", "По [title — заполнить] мысли", "[дата: указать]", "[Заполнить: фамилию, имя и отчество]", "[insert date here]", "[your name]", "Том <?= $city ?>.", "<? echo $x ?>", "&lt;?= $x ?&gt;", "По вопросу ___________ (дата) решено", "____(подпись, печать)", "Автор: __author_name__.", "Уважаемый __имя__, пишем", "__ФИО__"]
NO_FIELDS = ["Он хотел [указать на ошибку] ему.", "[your Majesty] said", '<?xml version="1.0"?> файл', "____ линия", "___\n(примечание)", "__важно__ и __Дата__ выхода", "if __name__ == '__main__':", "__title__ = 'x'", "[стр. 9] и [так указать следует]"]


def test_fields_of_every_form():
    finder = p10.ResidueFinder()
    assert [t for t in FIELDS if (finder.find(t) or ("",))[0] != "placeholder"] == []
    assert [t for t in NO_FIELDS if finder.find(t)] == []


def test_words():
    assert words("Ёлка-2, да_нет: é1") == ["елка", "2", "да", "нет", "é1"] and words(None) == []


def test_cutting_leaks_is_the_same_for_any_block_size(spark):
    rnd = random.Random(8)
    vocabulary = [f"слово{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=20))) for i in range(12)]
    rows = []
    for i in range(40):
        a, b = (rnd.choice(items)[1].split() for _ in "ab")
        rows.append((i, " ".join([*rnd.choices(vocabulary, k=5), *a[:4], *b[3:14], *a[4:12], *rnd.choices(vocabulary, k=5)])))
    docs, held = spark.createDataFrame([*rows, (99, None)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, several = ({tuple(r) for r in p8.without_leaks(docs, held, "doc_id", "text", "item_id", "text", block_words=n).collect()} for n in (10_000, 60))
    assert one == several and sum(r[2] for r in one) > 100
    whole, parts = ({tuple(r) for r in p8.leaked_items(docs, held, "doc_id", "text", "item_id", "text", block_words=n).collect()} for n in (10_000, 60))
    assert whole == parts and whole


def test_documents_of_residue_are_left_out(spark):
    prose = "Крестьянское хозяйство медленно раскрывает общественную природу труда. " * 5
    rows = [(1, "Страница не найдена"), (2, prose + "Страница не найдена."), (3, prose), (4, None), (5, ""), (None, "Lorem ipsum dolor sit amet"), (3, prose), (6, prose + "{{ name }}")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("residue", F.lit("x"))
    got = {r.id: r.residue for r in p10.without_residue(df, "id", "text").collect()}
    assert got == {2: "error_page", 3: None, 4: None, 5: None, 6: "placeholder"}
