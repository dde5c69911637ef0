import pytest

from parchment.llm import scans

COUNTS = {w: 400 for w in "the installer shall inspect ground snow load where stair is enclosed and fire rated doors of oak building manual liqueax a it to hall high chapter trap seal mortar".split()} | {"retardant": 50, "treated": 50}
LEX = scans.Lexicon(COUNTS, frozenset({"fire-retardant", "retardant-treated", "fire-rated"}))


def kinds(text, page=7, titles=(), printed=None, stem=""):
    b = scans.Block(text.split("\n"))
    return [sorted(x) for x in scans.readings(b, LEX, set(titles), page, printed, stem)[:4]]


def test_cuts():
    assert kinds("the instal-\nler shall inspect")[2] == [0]
    assert kinds("the instal¬\nler shall inspect")[2] == [0]
    assert kinds("the instal­\nler shall inspect")[2] == [0]
    assert kinds("where the fire-\nretardant-treated oak")[2] == []
    assert kinds("the instal-\nLiqueax notice\nler shall inspect")[2] == [0]
    assert kinds("the stair - it\nis") [2] == []


def test_misread():
    for seen in ("sball", "irispect", "giound", "5hall", "wbere", "encloscd", "d0ors", "sna1l"):
        got = kinds(f"the {seen} of oak")[3]
        assert got == ([0] if scans.Lexicon(COUNTS, frozenset())[seen][1] else []), seen
    assert kinds("the sball of oak")[3] == [0] and kinds("the shall of oak 12 m2 Zemaisk")[3] == []
    assert kinds("the ins7aller", titles=())[3] == [0]


def test_pages_and_headers():
    for label in ("7", "- 7 -", "[7]", "Page 7", "vii", "1-7", "Page l7", "[1O]"):
        assert kinds(f"the stair\nis oak\n{label}")[1] == [2], label
    assert kinds("the stair\nis oak\n38")[1] == [] and kinds("the stair\nis oak\n7\nand fire\nrated doors")[1] == []
    t = {"liqueax building manual", "trap seal and mortar\t^"}
    assert kinds("Liqueax Building Manual   17.2 - 9\nthe stair\nis oak", titles=t)[0] == [0]
    assert kinds("7\nCHAPTER 1 TRAP SEAL AND MORTAR\nthe stair\nis oak", titles=t)[:2] == [[1], [0]]
    assert kinds("the stair\nis oak\nit is\nTrap Seal And Mortar\nthe hall\nit is\nof oak", titles=t)[0] == []


def test_labels():
    for label, bad in (("l4", True), ("3S", True), ("1-1I", True), ("l", True), ("14", False), ("xiv", False), ("B-5", False), ("S-16", False), ("1-7", False), ("", False), (None, False), ("Intro", False)):
        assert scans.misread_label(label) is bad, label
    assert scans.true_label("l4") == "14" and scans.true_label("xiv") == "xiv"


def test_paragraphs_and_decoding():
    b = scans.Block("Liqueax Building Manual\nthe instal-\nler sball inspect the stair.\nThe hall is oak and the ground snow is high\nand the doors of oak.\n7".split("\n"))
    assert scans.paragraphs(b, scans.readings(b, LEX, {"liqueax building manual"}, 7, None, "", whole=True)) == ["the installer shall inspect the stair.", "The hall is oak and the ground snow is high and the doors of oak."]
    assert [(a.text, a.kind) for a in scans.decode(["groundsnow", "lo", "ad"], scans.Lexicon(COUNTS, frozenset()))] == [("ground snow", "split"), ("load", "merger")]
    b = scans.Block([""])
    assert scans.paragraphs(b, scans.readings(b, LEX, set(), None, None, "", whole=True)) == []


def test_one_lattice_over_line_ends():
    """Splits, mergers, confusions and cut words compete in one reading of the de-lined stream."""
    b = scans.Block("the ground sn\now load of the in-\nA Notice Here\nstal1er shall ins pect\nthe groundsnow".split("\n"))
    found = scans.readings(b, LEX, set(), 7, None, "", whole=True)
    assert [(a.text, a.kind) for a in found.path if a.kind != "word"] == [("snow", "merger"), ("installer", "cut"), ("inspect", "merger"), ("ground snow", "split")]
    assert found.cuts == {1} and found.misread == {3}
    text = " ".join(scans.paragraphs(b, found))
    assert "ground snow load of the installer" in text and "shall inspect the ground snow" in text


@pytest.mark.parametrize("bound", [200_000, 0])
def test_tables(spark, monkeypatch, bound):
    monkeypatch.setattr(scans, "BROADCAST_ROWS", bound)
    e = "evidence_id string, source_id string, publication_key string, pdf_page int, printed_page string, text string, titles string"
    p = "line_id string, source_id string, pdf_page int, text string"
    body = "the installer shall inspect the stair of the hall"
    ev = [(f"e{i}", "s", "liqueax-2000", i, "l4" if i == 3 else str(i), f"{body}\nthe sball of the hall" if i == 5 else body, "x") for i in range(60)] + [("n", None, None, None, None, None, None), ("z", "s", "k", None, None, "", "")]
    ev += ev[:3]
    pl = [(f"p{i:02}:{j}", "s", i, t) for i in range(5) for j, t in enumerate(["Liqueax Building Manual", "the stair of the instal-", "ler shall inspect", f"- {i} -"])] + [("q", None, None, "the stair"), ("r", "s", 1, None)]
    pl += pl[:4]
    run = scans.Scans(spark.createDataFrame(ev, e), spark.createDataFrame(pl, p))
    got = {tuple(r) for r in run.noise().collect()}
    want = {("evidence", "e3", "printed_page"), ("evidence", "e5", "misread")}
    want |= {("page_line", f"p{i:02}:{j}", k) for i in range(5) for j, k in ((0, "running_header"), (1, "hyphen_break"), (3, "page_number"))}
    assert got == want
    text = {(r.row_key, r.paragraph_no): r.text for r in run.repaired().collect()}
    assert text["e5", 1].endswith("the shall of the hall") and text["p00:0", 1] == "the stair of the installer shall inspect"
    none = scans.Scans(spark.createDataFrame([], e), spark.createDataFrame([], p))
    assert none.noise().count() == 0 and none.repaired().count() == 0
