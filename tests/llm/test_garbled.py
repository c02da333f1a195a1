"""Wrongly decoded passages: found, restored, and what must be left alone."""

import numpy as np
import pytest

from strandline.llm import garbled as G

CLEAN = [
    "La función devuelve 651 filas cuando la sesión está vacía. También habría que limpiar la caché antes de la migración.",
    "Die Prüfung schlägt fehl, weil die Übergabe überspringt. Nach dem Zurücksetzen müssen 175 Zeilen neu gezählt werden.",
    "Не удаляйте строки: сначала проверка, потом журнал, затем таблица. Объём данных растёт.",
    "Wczoraj łączyliśmy 293 wierszy, dziś już więcej. Trzeba usunąć zależność i sprawdzić różnicę.",
    "Don’t touch the file – it’s generated. The café-style naming is naïve — that’s the whole story. Budget: €40, ±85 %.",
    "検索結果の順序が正しくありません。確認が必要な項目は分割、監視、順序です。",
    "需要检查连接、检索和顺序。搜索结果的顺序不正确。",
    "├── branch.rs\n✓ merge (12 ms)",
]
RARE = ["Ω≈ç√ keyboard mash", "√2 ≈ 1.414, ∫ and ∑", "Ðe old rune, þorn", "👩‍💻🧵🇵🇹 emoji", "Ελληνικά: δοκιμή", "Tiếng Việt: kiểm thử đã chạy xong", "╔══╗\n║ ok ║\n╚══╝", "Escaped: \\u00e9 &eacute; %C3%A9", "L’ÂGE DU CACHE EST DÉPASSÉ", "ATENÇÃO: NÃO remova"]
SCHEMA = "doc_id long, text string, k string, t string"


@pytest.fixture(scope="module")
def corpus():
    return [f"{t} {i}." for i in range(150) for t in CLEAN] + RARE * 2


@pytest.mark.parametrize(
    ("k", "wrong", "right"),
    [(0, "cp1252", "utf-8"), (0, "latin-1", "utf-8"), (1, "cp437", "utf-8"), (1, "cp850", "utf-8"), (4, "cp1252", "utf-8"), (4, "mac_roman", "utf-8"), (4, "cp1251", "utf-8"), (2, "latin-1", "utf-8"), (2, "latin-1", "cp1251"), (2, "koi8-r", "cp1251"), (3, "latin-1", "cp1250"), (5, "latin-1", "euc_jp"), (5, "latin-1", "utf-8"), (6, "latin-1", "gb18030"), (1, "mac_roman", "latin-1"), (7, "latin-1", "utf-8")],
)
def test_round_trip(restorer, k, wrong, right):
    bad = CLEAN[k].encode(right).decode(wrong)
    text, passages, lost = restorer.restore(f"{CLEAN[4]}\n{bad}\n{CLEAN[0]}")
    assert passages and not lost and text == f"{CLEAN[4]}\n{CLEAN[k]}\n{CLEAN[0]}"


def test_twice(restorer):
    bad = CLEAN[0].encode().decode("latin-1").encode().decode("latin-1")
    assert restorer.restore(bad)[0] == CLEAN[0]


@pytest.mark.parametrize("text", [*CLEAN, *RARE, "", "a", "plain", "\n"])
def test_left_alone(restorer, text):
    assert restorer.restore(text) == (text, 0, 0)


def test_lost(restorer):
    assert restorer.restore(CLEAN[1].encode("latin-1").decode("utf-8", "replace"))[2] > 0


@pytest.fixture(scope="module")
def restorer(spark, corpus):
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(corpus)], SCHEMA)
    return G.Restorer(G.pair_model(df))


def test_operator(spark, corpus):
    bad = CLEAN[0].encode().decode("latin-1")
    texts = [*corpus, bad, bad, None, "", " ", "x" * 10 + bad + "y" * 300_000]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)
    n = len(corpus)
    got = {r.doc_id: r for r in G.restore_texts(df).collect()}
    assert sorted(got) == [n, n + 1, n + 5] == sorted(r[0] for r in G.garbled_documents(df).collect())
    assert got[n].restored_text == CLEAN[0]
    assert G.garbled_documents(df.limit(0)).count() == 0


def test_segments_against_brute_force():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        s = rnd.normal(size=12) - 0.2
        want = []

        def cover(lo, hi, s=s, want=want):
            best = max(((s[i:j].sum(), -i, -j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
            if best[0] > 0:
                i, j = -best[1], -best[2]
                want.append((i, j))
                cover(lo, i)
                cover(j, hi)

        cover(0, len(s))
        assert G.segments(s.tolist()) == sorted(want)


def test_lines_of_any_length(spark, corpus):
    # a corpus in which one changed character in a word is too little for itself
    texts = [*corpus, *["Le cœur et l’œuvre: vœux, nœud. ¿Qué? 5 m³ de agua, ¿y? Wczoraj dziś już dziś."] * 200]
    restorer = G.Restorer(G.pair_model(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)))
    assert not restorer.inverse(" ", "dziœ", " ")
    filler = "plain words about rows and tables stand here "
    good = f" {filler}".join(["dziś", "już"] * 4)
    bad = good.encode("cp1250").decode("cp1252")
    for before, after in ((1, 1), (20, 20), (44, 45), (100, 0), (0, 100), (2000, 2000)):
        got = restorer.restore(f"{filler * before}{bad} {filler * after}")
        assert got[0] == f"{filler * before}{good} {filler * after}", (before, after, got[1:])


def test_lists_and_single_texts_say_the_same(restorer, corpus):
    texts = [None, "", *corpus[:400], CLEAN[0].encode().decode("latin-1"), "plain", CLEAN[1].encode().decode("cp437"), "x", "é", "ab � cd", "ab\ufffdcd", "�", None]
    got = dict(restorer.restore_all(texts))
    assert {k: restorer.restore(t) for k, t in enumerate(texts) if t and restorer.restore(t) != (t, 0, 0)} == got


def test_ways_that_are_ruled_out_would_not_do(restorer):
    """No mapping that a character rules out gives a reading of common characters."""
    for run in ["dziœ", "Ã©tÃ©", "ďťż", "Ð¿Ñ€Ð¸", "ä½ å¥½", "³ód", "Œuvre—", "żółć"]:
        left = {(w, r) for r, ws in restorer.mappings(run) for w in ws}
        for wrong in G.WRONG:
            for right in G.SINGLE - {wrong}:
                data = G.to_bytes(run, wrong)
                said = G.from_bytes(data, right) if data is not None else None
                if wrong == "gb18030" and any(len(c.encode(wrong)) == 4 for c in run):
                    continue  # ruled out by itself
                if said is not None and restorer.model.common.issuperset(said):
                    assert (wrong, right) in left
                    if wrong not in G.WIDE:
                        far = sum(float(s) for s, (a, b) in zip(restorer.model.scores(said)[0], zip(said, said[1:])) if b > "\x7f")
                        assert far <= restorer.reach(run)[G.WRONG.index(wrong), G.RIGHT.index(right)] + 0.01 * len(run) + (12 if said[0] > "\x7f" else 0)


def test_next_to_correct_text_of_another_script(restorer):
    """What is improbable may begin in correct text: on the line before, or on the same one."""
    bad, good = CLEAN[5].encode("cp932").decode("latin-1"), CLEAN[5]
    for before, after in ((CLEAN[6] + "\n- ", ""), (CLEAN[6] + "\n- ", "\n" + CLEAN[2]), (CLEAN[6], "\n" + CLEAN[6]), (CLEAN[6], " " + CLEAN[6])):
        text, passages, lost = restorer.restore(before + bad + after)
        assert passages and not lost and text == before + good + after, (before, after)


def test_garbled_four_times(restorer):
    bad = CLEAN[0]
    for _ in range(4):
        bad = bad.encode().decode("latin-1")
    assert restorer.restore(bad)[0] == CLEAN[0]
