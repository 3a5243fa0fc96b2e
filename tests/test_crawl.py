import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from spanloom import cli
from spanloom.sources import crawl, rest

PAPERS = ["10.1/a", "10.1/b c", "sd7"]


class Api(BaseHTTPRequestHandler):
    """A small collection; broken: addresses that fail so many times; missing: those that are not there."""

    asked: Counter = Counter()
    broken: dict = {}
    missing: set = set()

    def answer_of(self, path):
        p = path.replace("%20", " ").strip("/").split("/")
        if p == ["collection", "NAME"]:
            return [{"name": "NAME", "collection_id": 12}]
        if p == ["collection", "12", "papers"]:
            return [{"doi": "10.1/a", "id": "x"}, {"doi": "10.1/b c"}, {"doi": "", "id": "sd7"}, {"doi": "10.1/a"}, {"title": "neither"}]
        if p[:3] == ["collection", "12", "paper"]:
            if "figure" not in p:
                doi = "/".join(p[3:])
                return {"doi": doi, "title": "T", "nbFigures": str(PAPERS.index(doi))}
            doi, k = "/".join(p[3 : p.index("figure")]), p[-1]
            return {"figure_id": f"{PAPERS.index(doi)}{k}", "label": f"Figure {k}", "caption": "<p>A cell. More.</p>", "panels": [f"{PAPERS.index(doi)}{k}{x}" for x in (1, 2)] + ["shared"]}
        if p[0] == "panel":
            return {"current_panel_id": p[1], "paper": {"doi": "d"}, "figure": {"label": "F", "figure_id": p[1][:2], "panels": [{"panel_id": p[1], "label": "A", "formatted_caption": f"<p>panel {p[1]}</p>"}]}}
        return None

    def do_GET(self):
        self.asked[self.path] += 1
        if self.broken.get(self.path, 0) > 0:
            self.broken[self.path] -= 1
            self.send_error(502)
            return
        found = None if self.path in self.missing else self.answer_of(self.path)
        if found is None:
            self.send_error(404)
            return
        body = json.dumps(found).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def api():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Api)
    Api.asked, Api.broken, Api.missing = Counter(), {}, set()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


#: 1 collection, 1 list, 3 papers, 0 + 1 + 2 figures, 2 panels for each figure and one that all name.
WANTED = 1 + 1 + 3 + 3 + 6 + 1


def test_a_collection_is_crawled_once(spark, api, tmp_path):
    found = crawl.crawl_collection(spark, api, "NAME", str(tmp_path / "s"), task=2).collect()
    assert Counter(r.level for r in found) == {0: 1, 1: 1, 2: 3, 3: 3, 4: 7}
    assert len(Api.asked) == WANTED and set(Api.asked.values()) == {1}
    assert {r.status for r in found} == {200}
    assert sorted(r.path for r in found if r.level == 2) == [["12", p] for p in PAPERS]
    assert {tuple(r.path) for r in found if r.level == 3} == {("12", "10.1/b c", "1"), ("12", "sd7", "1"), ("12", "sd7", "2")}
    again = crawl.crawl_collection(spark, api, "NAME", str(tmp_path / "s"))
    assert again.count() == WANTED and set(Api.asked.values()) == {1}


def test_failures_are_tried_again_and_missing_pages_are_not(spark, api, tmp_path):
    Api.broken = {"/collection/12/paper/sd7": 2, "/panel/111": 10_000}
    Api.missing = {"/panel/112"}
    quick = lambda url: rest.answer(url, wait=lambda s: None)
    store = str(tmp_path / "s")
    found = crawl.crawl_collection(spark, api, "NAME", store, get=quick, tries=2).collect()
    assert Api.asked["/collection/12/paper/sd7"] == 3 and Api.asked["/panel/112"] == 1
    assert Api.asked["/panel/111"] == 2 * (rest.RETRIES + 1)
    assert {r.url[-3:]: r.status for r in found if r.status != 200} == {"111": 502, "112": 404}
    Api.broken = {}
    before = Counter(Api.asked)
    crawl.crawl_collection(spark, api, "NAME", store, get=quick)
    assert Api.asked - before == Counter({"/panel/111": 1})
    assert crawl.settled(crawl.answers(spark, store)).count() == WANTED


def test_a_crawl_that_was_cut_off_goes_on(spark, api, tmp_path):
    store = str(tmp_path / "s")

    def dies(url):
        if url.endswith("/panel/212"):
            raise RuntimeError("the cluster is gone")
        return rest.answer(url)

    with pytest.raises(Exception, match="the cluster is gone"):
        crawl.crawl_collection(spark, api, "NAME", store, get=dies, wave=2, task=1)
    written = {r.url.removeprefix(api).replace(" ", "%20") for r in crawl.answers(spark, store).collect()}
    assert len(written) >= WANTED - 7
    crawl.crawl_collection(spark, api, "NAME", store)
    assert all(Api.asked[p] == 1 for p in written) and max(Api.asked.values()) <= 2
    assert crawl.answers(spark, store).count() == WANTED


def test_no_such_collection(spark, api, tmp_path):
    found = crawl.crawl_collection(spark, api, "OTHER", str(tmp_path / "s")).collect()
    assert [(r.level, r.status) for r in found] == [(0, 404)]


def test_pause_and_address_named_twice(spark, tmp_path):
    seeds = spark.createDataFrame([("u1", ["b"]), ("u1", ["a"]), (None, ["c"]), ("u2", None)], crawl.ADDRESS)
    found = crawl.crawl(seeds, [lambda rows: rows.selectExpr("'u1' as url", "path")], str(tmp_path / "s"), get=lambda u: (200, "[]"), pause=0.01).collect()
    assert sorted((r.level, r.url, r.path) for r in found) == [(0, "u1", ["a"]), (0, "u2", None)]


def test_fetch_command(spark, api, tmp_path):
    cli.main(["fetch", "NAME", str(tmp_path / "out"), "--api", api, "--store", str(tmp_path / "s"), "--pause", "0"], spark)
    files = spark.read.text(str(tmp_path / "out"), wholetext=True).collect()
    assert len(files) == 3
    text = next(r.value for r in files if "b c" in r.value)
    assert "<label>Figure 1</label>" in text and "panel 111" in text and "panel 112" in text
