"""A URL target is copied in chunks to the folder that driver and executors share."""

import http.server
import os
import threading

import pytest

from veritab.plans import suite

BODY = b"Id,Name\n" + b"".join(b"%d,name\n" % k for k in range(5000))


@pytest.fixture()
def url():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(BODY) + (9 if "short" in self.path else 0)))
            self.end_headers()
            self.wfile.write(BODY)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_url_is_read_from_the_shared_folder(spark, url, tmp_path, monkeypatch):
    monkeypatch.setattr(suite, "CHUNK", 1000)
    monkeypatch.setattr(suite, "shared_dir", lambda session: str(tmp_path))
    with suite.local(spark, f"{url}/x.csv") as path:
        assert str(tmp_path) in path and spark.read.text(path).count() == 5001
    assert os.listdir(tmp_path) == []
    with pytest.raises(OSError), suite.local(spark, f"{url}/short.csv"):
        pass
    assert os.listdir(tmp_path) == []
