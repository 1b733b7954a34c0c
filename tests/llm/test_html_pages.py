"""Main text of pages without telling names, in several scripts, and of what inline elements hide."""

import time

from dialoom.llm import html_text

TREE = html_text.train()
RAIN = ("After three dry months it rained for two days, and the river rose by a metre before the sluices were opened.", "Farmers along the lower valley had moved their cattle to higher ground on Sunday, as they do each spring.", "No one was hurt.", "The ferry did not run, and the school in the next village stayed closed until the road had been cleared of mud.")
STONE = ("这是一个关于古老石桥的故事，委员会在星期二开会并且同意在冬天来临之前修复这座桥梁。", "工程师们认为桥墩仍然坚固，但是桥面必须全部更换，费用由两个村庄共同承担。", "没有人反对。", "工程将在九月开始，预计需要十一个星期，在此期间车辆必须绕行北边的公路。")
TEMPLE = ("古い寺の鐘は三百年前に作られ、今でも毎朝六時に町の人々を起こしている。", "去年の冬、鐘に小さなひびが見つかり、職人たちが春まで修理を続けた。", "音は変わらない。", "町は来月、修理の完成を祝う小さな祭りを開く予定である。")
LINKS = {"en": ("Home page", "All the other stories", "Write to us"), "zh": ("首页", "新闻中心的全部内容", "联系我们"), "ja": ("ホーム", "すべてのニュース一覧", "お問い合わせ")}
#: Layouts without names: where links and paragraphs go. {l}: a row of links, {h}: the heading, {0}..{3}: paragraphs.
LAYOUTS = (
    "<div>{l}</div><h1>{h}</h1><p>{0}<p>{1}<p>{2}<p>{3}<div>{l}</div>",
    "<table><tr><td>{l}</td></tr></table><h2>{h}</h2><div>{0}</div><div>{1}</div><div>{2}</div><div>{3}</div><p>{l}</p>",
    "<p>{l}</p><h1><b>{h}</b></h1><p><i>{0}</i></p><p>{1}</p><p>{2}</p><p>{3}</p><ul><li>{l}</li></ul>",
)


def linked(words, span):
    return " ".join(f"<a href=/{i}>{'<span class=t>' + w + '</span>' if span else w}</a>" for i, w in enumerate(words))


def test_pages_without_names_in_three_scripts():
    """Block precision and recall over 18 pages: with plain links and with spans inside them."""
    hits = wanted = given = 0
    for language, heading, paragraphs in (("en", "Rain at last", RAIN), ("zh", "古桥将被修复", STONE), ("ja", "鐘の音がもどる", TEMPLE)):
        for layout in LAYOUTS:
            for span in (False, True):
                page = layout.format(*paragraphs, h=heading, l=linked(LINKS[language], span))
                found = html_text.main_text(page, TREE).split("\n\n")
                main = {heading, *paragraphs}
                hits, wanted, given = hits + len(main & set(found)), wanted + len(main), given + len(found)
    assert hits / wanted >= 0.97 and hits / given >= 0.97


def test_spans_keep_links_links():
    found = html_text.blocks("<div><a href=/1><span class=t>Home page of the site</span></a> and <a href=/2><em title=x>more of it</em></a></div>")
    assert [(b.words, b.linked) for b in found] == [(9, 8)]


def test_what_spans_hide_is_no_text():
    body = f"{RAIN[0]} <span class='ad-box'>Buy <span>two</span> lamps</span>so it went<b hidden>, never</b> <em style='display: none'>unseen</em><span class=name>well</span>."
    page = f"<article><h1>Rain</h1><p>{body}</p><p>{RAIN[1]}</p></article>"
    assert html_text.main_text(page, TREE).split("\n\n")[1] == f"{RAIN[0]} so it went well."


def test_unclosed_hidden_spans_end_with_their_element():
    page = f"<article><h1>Rain</h1><div><p>{RAIN[0]} <span class=ad>Buy lamps<p>and more</div><p>{RAIN[1]}</p></article>"
    assert html_text.main_text(page, TREE) == f"Rain\n\n{RAIN[0]}\n\n{RAIN[1]}"


def test_many_inline_elements_take_no_square_time():
    began = time.time()
    for part in ("<span class=ad>", "<span hidden><i>", "</span>", "<b hidden>x</b>", "<span class=ad>x<div>"):
        html_text.main_text(part * (1_000_000 // len(part)), TREE)
    assert time.time() - began < 20


def test_words_of_unspaced_scripts():
    assert html_text.word_count("one two") == 2 and html_text.word_count("") == 0 and html_text.word_count("été ici") == 2 and html_text.word_count("古桥将被修复") == 7
