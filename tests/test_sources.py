"""Files, sessions and folders."""

import sys
import types

import pytest

from loomline.conf import EngineConf
from loomline.session import SETTINGS, session, shared_dir
from loomline.sources import documents


class Paper:
    """Stands in for an open PDF: its content is pages between bars."""

    def __init__(self, stream, filetype):
        assert filetype == "pdf"
        self.pages = stream.decode().split("|")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def __iter__(self):
        return iter([types.SimpleNamespace(get_text=lambda t=t: t or None) for t in self.pages])


def paper_pages(content: bytes) -> list[str]:
    """``pdf_pages`` with the stand-in as the library, also in workers."""
    sys.modules["pymupdf"] = types.SimpleNamespace(open=lambda stream, filetype: Paper(stream, filetype))
    try:
        return documents.pdf_pages(content)
    finally:
        del sys.modules["pymupdf"]


def test_pdf_pages(spark, tmp_path):
    assert paper_pages(b"one||three") == ["one", "", "three"]
    (tmp_path / "a_paper.pdf").write_bytes(b"first|second||last")
    (tmp_path / "blank.pdf").write_bytes(b"|")
    docs, pages = documents.read_files(spark, str(tmp_path), paper_pages, "*.pdf")
    kept = documents.accepted(docs, pages, only_pdf=True).collect()
    assert [(d.title, d.page_count) for d in kept] == [("A Paper", 4)]
    assert [(p.page_no, p.content) for p in documents.pages_of(pages, kept[0].id).collect()] == [(1, "first"), (2, "second"), (3, ""), (4, "last")]


def test_pdf_pages_without_a_library(monkeypatch):
    monkeypatch.setitem(sys.modules, "pymupdf", None)
    with pytest.raises(RuntimeError, match="another parser"):
        documents.pdf_pages(b"")


def test_session_has_the_settings(spark):
    assert session().conf.get("spark.sql.session.timeZone") == "UTC"
    for key, value in SETTINGS.items():
        assert spark.conf.get(key) == value


def test_folders_are_under_the_root():
    conf = EngineConf(root="/shared/db/")
    assert conf.table("pages") == "/shared/db/pages"


class Cluster:
    """A session of a cluster without a shared folder."""

    def __init__(self, master, held=None):
        self.sparkContext = types.SimpleNamespace(master=master)
        self.held = {"spark.checkpoint.dir": held} if held else {}
        self.conf = types.SimpleNamespace(get=lambda k, d=None: self.held.get(k, d), set=self.held.__setitem__)


def test_shared_folder():
    assert shared_dir(Cluster("spark://host:1", "/shared/x/")) == "/shared/x"
    for master in ("spark://host:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Cluster(master))
    one = Cluster("local[4]")
    assert shared_dir(one) == one.held["spark.checkpoint.dir"]
