"""Moves and copies that are lost half-way, and targets that appear meanwhile."""

import errno
import os
import shutil

import pandas as pd
import pytest

from stowage.sinks import apply


class Lost(BaseException):
    """The executor is gone."""


def carry_out(action, source, target, size, digest=None, token="t0"):
    row = {"path": str(source), "action": action, "target": str(target), "size": size, "hash": digest, "token": token}
    (out,) = apply._worker()([pd.DataFrame([row])])
    return out.status[0]


def lose(monkeypatch, name, which=1):
    """The ``which``-th call of os.<name> takes place, then the worker is lost."""
    real, calls = getattr(os, name), []

    def call(*args, **options):
        real(*args, **options)
        calls.append(args)
        if len(calls) == which:
            raise Lost

    monkeypatch.setattr(os, name, call)


def other_device(monkeypatch):
    """Links from the folder ``here`` to the folder ``there`` cross devices."""
    real = os.link

    def link(source, target, **options):
        if "/here/" in str(source) and "/there/" in str(target):
            raise OSError(errno.EXDEV, "another device")
        real(source, target, **options)

    monkeypatch.setattr(os, "link", link)


@pytest.fixture
def place(tmp_path):
    source, target = tmp_path / "here" / "a.txt", tmp_path / "there" / "sub" / "a.txt"
    source.parent.mkdir()
    source.write_text("content")
    return source, target


def settled(source, target, moved=True):
    assert target.read_text() == "content" and source.exists() != moved
    assert os.listdir(target.parent) == [target.name]


@pytest.mark.parametrize("devices", [1, 2])
@pytest.mark.parametrize("action", ["move", "copy"])
@pytest.mark.parametrize("step", [("link", 1), ("unlink", 1), ("unlink", 2)])
def test_lost_after_any_step(monkeypatch, place, devices, action, step):
    source, target = place
    with monkeypatch.context() as patch:
        if devices == 2:
            other_device(patch)
        lose(patch, *step)
        try:
            first = carry_out(action, source, target, 7)
        except Lost:
            first = "lost"
    with monkeypatch.context() as patch:
        if devices == 2:
            other_device(patch)
        again = carry_out(action, source, target, 7)
    assert first == "lost" or again == "already_done"
    assert again in ("done", "already_done")
    settled(source, target, action == "move")
    assert carry_out(action, source, target, 7) == "already_done"


def test_lost_while_copying(monkeypatch, place):
    source, target = place
    with monkeypatch.context() as patch:
        other_device(patch)

        def copy(source, part, **options):
            with open(part, "w") as stream:
                stream.write("con")
            raise Lost

        patch.setattr(shutil, "copy2", copy)
        with pytest.raises(Lost):
            carry_out("move", source, target, 7)
    assert not target.exists() and source.exists()
    other_device(monkeypatch)
    assert carry_out("move", source, target, 7) == "done"
    settled(source, target)


@pytest.mark.parametrize("devices", [1, 2])
@pytest.mark.parametrize("action", ["move", "copy"])
def test_a_target_that_appears_meanwhile_is_not_overwritten(monkeypatch, place, devices, action):
    source, target = place
    real = os.link

    def link(one, two, **options):
        if str(two) == str(target):
            target.write_text("another")
        if devices == 2 and "/here/" in str(one):
            raise OSError(errno.EXDEV, "another device")
        real(one, two, **options)

    monkeypatch.setattr(os, "link", link)
    assert carry_out(action, source, target, 7) == "failed"
    assert source.read_text() == "content" and target.read_text() == "another"
    assert os.listdir(target.parent) == ["a.txt"]


def test_no_links_on_the_file_system(monkeypatch, place):
    source, target = place

    def link(one, two, **options):
        raise OSError(errno.EPERM, "no links")

    monkeypatch.setattr(os, "link", link)
    assert carry_out("move", source, target, 7) == "done"
    settled(source, target)
    source.write_text("content")
    target.write_text("another")
    assert carry_out("move", source, target, 7) == "failed" and target.read_text() == "another"


def test_a_copy_of_equal_content_is_done_and_another_is_not(place):
    source, target = place
    target.parent.mkdir(parents=True)
    target.write_text("CONTENT")
    assert carry_out("copy", source, target, 7) == "failed"
    target.write_text("content")
    assert carry_out("copy", source, target, 7) == "already_done"


def test_a_journal_is_resumed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = []
    for i in range(8):
        (tmp_path / "in" / f"f{i}").write_text("x" * i)
        rows.append((str(tmp_path / "in" / f"f{i}"), "move", str(tmp_path / "out" / f"g{i}"), i))
    plan = spark.createDataFrame(rows, "path string, action string, target string, size long")
    journal = str(tmp_path / "journal")
    os.makedirs(tmp_path / "out")
    os.link(tmp_path / "in" / "f3", tmp_path / "out" / "g3")  # lost after the link
    os.rename(tmp_path / "in" / "f4", tmp_path / "out" / "g4")  # lost after the move
    found = {r.path[-2:]: r.status for r in apply.apply_plan(plan, journal).collect()}
    assert found == {f"f{i}": "already_done" if i == 4 else "done" for i in range(8)}
    assert not os.listdir(tmp_path / "in") and len(os.listdir(tmp_path / "out")) == 8
    again = apply.resume(spark, journal).collect()
    assert {r.status for r in again} == {"already_done"} and len(again) == 8
