import json
import threading
import time
import urllib.error
import urllib.request

import pytest

from loomline.conf import EngineConf
from loomline.plans.engine import Engine
from loomline.plans.http import serve


@pytest.fixture(scope="module")
def call(spark, tmp_path_factory):
    server = serve(Engine(spark, EngineConf(root=str(tmp_path_factory.mktemp("http")))), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def go(method, path, body=b""):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data=body or None, method=method)
        try:
            with urllib.request.urlopen(request, timeout=120) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    yield go
    server.shutdown()


def wait(call, job):
    for _ in range(120):
        got = call("GET", f"/api/jobs/{job}")[1]
        if got["status"] in ("done", "error"):
            return got
        time.sleep(0.5)
    raise AssertionError("the job does not end")


def test_life_of_a_document(call):
    assert call("GET", "/api/health") == (200, {"spark": True})
    assert len(call("GET", "/api/taxonomy")[1]) == 5
    text = "\f".join(f"Anna saw ship {i} leave the harbour. It rained." for i in range(12)).encode()
    status, docs = call("POST", "/api/documents?filename=the_ship.txt", text)
    assert status == 200 and docs[0]["title"] == "The Ship"
    doc = docs[0]["id"]
    assert call("POST", "/api/documents?filename=x.exe", text)[0] == 400 and call("POST", "/api/documents?filename=x.txt", b"  \n")[0] == 400
    for kind in ("naive", "timeline"):
        status, job = call("POST", f"/api/documents/{doc}/build/{kind}")
        assert status == 200 and wait(call, job["job_id"])["status"] == "done"
    assert call("POST", f"/api/documents/{doc}/build/other")[0] == 400 and call("POST", "/api/documents/none/build/naive")[0] == 404
    assert len(call("GET", f"/api/documents/{doc}/jobs")[1]) == 2 and call("GET", "/api/jobs/none")[0] == 404
    question = json.dumps({"question": "When did it rain?"}).encode()
    assert call("POST", f"/api/documents/{doc}/ask/naive", question)[1]["answer"] and call("POST", f"/api/documents/{doc}/ask/timeline", question)[1]["citations"]
    assert set(call("POST", f"/api/documents/{doc}/compare", question)[1]) == {"naive", "timeline"} and call("POST", f"/api/documents/{doc}/compare")[0] == 422
    events = call("GET", f"/api/documents/{doc}/events")[1]
    graph = call("GET", f"/api/documents/{doc}/graph")[1]
    assert len(graph["nodes"]) == len(events) > 0 and len(graph["edges"]) >= len(events) - 1
    assert len(call("GET", f"/api/documents/{doc}/observations?limit=1")[1]) == 1
    assert call("GET", f"/api/documents/{doc}/metrics")[1]["events_total"] == len(events)
    assert len(call("GET", f"/api/documents/{doc}/taxonomy")[1]) == 5 and call("GET", "/api/documents/none/taxonomy")[0] == 404
    assert call("GET", "/api/documents")[1][0]["timeline_ready"]
    assert call("DELETE", f"/api/documents/{doc}")[0] == 200 and call("GET", "/api/documents")[1] == []
    assert call("GET", "/api/other")[0] == 404
