"""Requests of each engine against a stub server, rates over lanes, retries and failures."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lexloom import cli
from lexloom.operators import engines, reviewer, translate

ISSUE = {"type": "tone", "severity": "info", "message": "m"}


class Stub(BaseHTTPRequestHandler):
    """Answers each path in its service's format, in upper case; texts with "bad" fail, whatever stands beside them."""

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.seen.append((time.monotonic(), self.path, dict(self.headers), body))
        upper = lambda texts: [t.upper() for t in texts]
        if self.path.endswith("/v2/translate"):
            texts = body["text"]
            answer = {"translations": [{"text": t} for t in upper(texts)]}
        elif self.path.endswith("/chat/completions"):
            ask = body["messages"][0]["content"]
            texts = [ask.split("\n\n", 1)[1]]
            told = json.dumps({"issues": [ISSUE]}) if "response_format" in body else f" {texts[0].upper()} "
            answer = {"choices": [{"message": {"content": told}}]}
        elif self.path.endswith("/api/generate"):
            texts = [body["prompt"].split("\n\n", 1)[1]]
            answer = {"response": texts[0].upper()}
        else:
            texts = body["q"]
            answer = {"translatedText": upper(texts)}
        failed = any("bad" in t for t in texts)
        data = json.dumps(answer).encode()
        self.send_response(500 if failed else 200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def stub():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    server.seen, server.url = [], f"http://127.0.0.1:{server.server_port}"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_deepl_request(stub):
    made = engines.deepl("zh", "en", "k", url=stub.url)
    assert made.translate(["a", "b"] * 30) == ["A", "B"] * 30
    (_, path, headers, body), second = stub.seen
    assert path == "/v2/translate" and headers["Authorization"] == "DeepL-Auth-Key k"
    assert (body["source_lang"], body["target_lang"], len(body["text"]), len(second[3]["text"])) == ("ZH", "EN", 50, 10)
    assert engines.deepl("zh", "en", "k:fx").inner.inner.url == "https://api-free.deepl.com/v2/translate"
    assert engines.deepl("zh", "en", "k").inner.inner.url == "https://api.deepl.com/v2/translate"
    long = "\n".join(["x" * 30_000] * 3)
    stub.seen.clear()
    assert made.translate([long]) == [long.upper()] and max(len(t) for s in stub.seen for t in s[3]["text"]) <= 50_000


def test_libre_request(stub):
    made = engines.libre("zh", "en", "k", url=stub.url)
    assert made.translate(["a", "y" * 6000, "b"]) == ["A", "Y" * 6000, "B"]
    assert [(s[1], len(s[3]["q"]), s[3]["api_key"], s[3]["format"]) for s in stub.seen] == [("/translate", 2, "k", "text"), ("/translate", 1, "k", "text")]


def test_chat_and_ollama_requests(stub):
    assert engines.chat("zh", "en", "k", "m", stub.url + "/v1/").translate(["a\n\nb", "c"]) == ["A\n\nB", "C"]
    _, path, headers, body = stub.seen[0]
    assert path == "/v1/chat/completions" and headers["Authorization"] == "Bearer k" and body["model"] == "m" and body["temperature"] == 0.3
    assert "from zh to en" in body["messages"][0]["content"]
    stub.seen.clear()
    assert engines.ollama("zh", "en", model="m", url=stub.url).translate(["a", "b"]) == ["A", "B"]
    assert [(s[1], s[3]["model"], s[3]["stream"]) for s in stub.seen] == [("/api/generate", "m", False)] * 2


def test_reviewer_request(spark, stub):
    pairs = spark.createDataFrame([(f"p{k}", "x" * 60, "y" * 60) for k in range(3)], "path string, a string, b string").coalesce(1)
    rows = reviewer.review_pairs(pairs, reviewer.Chat(stub.url, "k", "m", pause=0.2)).collect()
    assert [(r.issue_type, r.severity) for r in rows] == [("ai_tone", "info")] * 3
    at, _, headers, body = zip(*stub.seen)
    assert body[0]["temperature"] == 0.1 and body[0]["response_format"] == {"type": "json_object"} and at[2] - at[0] > 0.3


def test_factory():
    both = engines.provider("upper, identity", "zh", "en")
    assert both.translate(["a", "b", "c"]) == ["A", "b", "C"]
    made = engines.provider("chat,libre", "zh", "en", keys="k1,k2", models="m1", urls="http://a,http://b")
    assert made.providers[0].inner.http.url == "http://a/chat/completions" and made.providers[0].inner.http.pace.interval == 0.5
    assert made.providers[1].inner.url == "http://b/translate" and made.providers[1].inner.encode(["x"])["api_key"] == "k2"
    for work in (engines.provider, engines.lanes):
        with pytest.raises(ValueError, match="deepl"):
            work("none", "zh", "en")
    with pytest.raises(ValueError):
        translate.Lanes([])


def keys(spark, n):
    return spark.createDataFrame([(f"k{i}", f"text {i} `code` tail") for i in range(n)], "translation_key string, source_text string").repartition(7)


def test_a_rate_holds_over_all_lanes(spark, stub):
    made = engines.lanes("libre,ollama", "zh", "en", urls=f"{stub.url},{stub.url}", each=3, rates={"libre": 10.0})
    assert len(made) == 6
    got = translate.provide(keys(spark, 120), made, batch_size=2, with_calls=True).collect()
    assert {r.target_text.replace(" ", "") for r in got} == {f"TEXT{i}`code`TAIL" for i in range(120)}  # one engine strips its answers
    at = {path: sorted(t for t, p, *_ in stub.seen if p == path) for path in ("/translate", "/api/generate")}
    asked = at["/translate"]
    assert len(asked) > 15 and len(at["/api/generate"]) > 40
    # any second holds the rate's requests and at most one more of each lane
    most = max(sum(t <= x < t + 1 for x in asked) for t in asked)
    assert most <= 10 + 3 and asked[-1] - asked[0] > len(asked) / 10 * 0.7
    assert max(Counter(r.call for r in got).values()) <= 2


def test_a_bad_text_does_not_take_its_batch_with_it(spark, stub):
    service = engines.libre("zh", "en", url=stub.url)
    assert translate.call(service, ["a", " ", "b"]) == ["A", " ", "B"]
    assert translate.call(service, ["a", "bad", "b"], on_error="passthrough") == ["A", "bad", "B"]
    assert [s[3]["q"] for s in stub.seen[1:]] == [["a", "bad", "b"]] * 2 + [["a"], ["bad"], ["bad"], ["b"]]
    with pytest.raises(OSError):
        translate.call(service, ["a", "bad"])
    assert translate.call(service, ["bad"], on_error="passthrough") == ["bad"]
    rows = spark.createDataFrame([("1", "good"), ("2", "bad one"), ("3", "fine")], "translation_key string, source_text string")
    lanes = engines.lanes("libre", "zh", "en", urls=stub.url)
    assert {r.target_text for r in translate.provide(rows, lanes, on_error="passthrough").collect()} == {"GOOD", "bad one", "FINE"}


def test_the_command_line_asks_a_server(spark, stub, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.md").write_text("# ab 标题\n\nmore 正文 words\n")
    told = ["translate", str(root), str(tmp_path / "out"), "--translator", "libre", "--base-url", stub.url, "--max-workers", "2"]
    assert cli.main(told, spark) == 0
    assert (tmp_path / "out" / "a.md").read_text() == "# AB 标题\n\nMORE 正文 WORDS\n"
    first = len(stub.seen)
    memory = str(tmp_path / "memory")
    for k, want in ((1, True), (2, False)):  # what is known is not asked for again
        stub.seen.clear()
        assert cli.main([*told[:2], str(tmp_path / f"out{k}"), *told[3:], "--translation-memory", memory], spark) == 0
        assert bool(stub.seen) == want and (tmp_path / f"out{k}" / "a.md").read_text() == "# AB 标题\n\nMORE 正文 WORDS\n"
    assert first > 0


def test_models_from_the_command_line(spark, stub, tmp_path, capsys):
    """Review and model verification with their own addresses, a report, an applied manifest, and counts of what was looked at."""
    root, out = tmp_path / "tree", tmp_path / "out"
    root.mkdir()
    for k in range(6):
        (root / f"{k}.md").write_text(f"# 标题 {k}\n\n" + "some more 正文 words here\n" * 4)
    model = ["--review-with", "chat", "--review-base-url", stub.url, "--review-sample", "0.5", "--verify", "--verify-ai", "--verify-base-url", stub.url, "--verify-sample", "0.5", "--verify-max-files", "2"]
    done = ["translate", str(root), str(out), "--translator", "libre", "--base-url", stub.url, *model, "--verify-json-output", str(tmp_path / "report.json"), "--export-manifest", str(tmp_path / "m"), "--verbose"]
    assert cli.main(done, spark) == 0
    asked = [s[3]["messages"][0]["content"] for s in stub.seen if s[1] == "/chat/completions"]
    assert len(asked) == 3 + 2 and all("正文" in a for a in asked)
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["files"]["ai_reviewed"] == 2 and [i["type"] for i in report["issues"]] == ["ai_tone"] * 2 and report["summary"]["worst_severity"] == "info"
    assert cli.main(["verify", str(root), str(out), "--ai-check", "--ai-base-url", stub.url, "--ai-max-files", "1", "--fail-on", "info"], spark) == 1
    assert cli.main(["review", str(out), "--original", str(root), "--engine", "chat", "--base-url", stub.url, "--sample-rate", "1"], spark) == 0
    assert cli.main(["extract", str(root), str(tmp_path / "first")], spark) == 0
    assert cli.main(["translate-manifest", str(tmp_path / "first"), str(tmp_path / "filled"), "--translator", "upper"], spark) == 0
    assert cli.main(["translate", str(root), str(tmp_path / "applied"), "--apply-manifest", str(tmp_path / "filled")], spark) == 0
    assert (tmp_path / "applied" / "0.md").read_text().startswith("# 标题 0\n\nSOME MORE 正文 WORDS HERE\n")
    assert "tone: 6" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["verify", "a", "b", "--fail-on", "sometimes"], spark)
