"""Open ground: copies of a page, short blocks and unique runs stay; what the site repeats goes."""

from maskquery.llm import html_text


def extracted(spark, pages: dict[int, str]) -> dict[int, str]:
    rows = [(i, f"https://a.org/{i}", page) for i, page in pages.items()]
    return {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_short_blocks_and_unique_runs(spark):
    notice = "this very site keeps a long notice on each and every page"
    own = {i: " ".join(f"p{i}w{k}" for k in range(20)) for i in range(8)}
    pages = {i: f"<p>Home</p><h2>{'Summary' if i < 3 else f'Head {i}'}</h2><p>{own[i]}</p><p>{notice} number n{i} of many</p>" for i in own}
    pages[100] = pages[0]  # the same article under another id
    want = {i: f"{'Summary' if i < 3 else f'Head {i}'}\n{own[i]}\nn{i} of many" for i in own}  # "number" follows the notice everywhere
    assert extracted(spark, pages) == {**want, 100: want[0]}


def test_copies_alone_keep_their_text(spark):
    page = "<p>one article of more than six words under two ids</p>"
    assert set(extracted(spark, {1: page, 2: page}).values()) == {"one article of more than six words under two ids"}
