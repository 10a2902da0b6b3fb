from __future__ import annotations

import pytest

from keyfold.config import Settings, load


def test_order_of_sources(tmp_path):
    f = tmp_path / "settings"
    f.write_text("# how layers merge\nmerge_strategy = leveled\nmerge_threshold=7  # files\n\nread_only=true\n")
    assert load(env={}) == Settings()
    got = load(str(f), env={"KEYFOLD_MERGE_THRESHOLD": "9", "OTHER": "x"})
    assert got == Settings(merge_strategy="leveled", merge_threshold=9, read_only=True)
    assert got.level_bytes(2) == 1000 * 1024 * 1024


@pytest.mark.parametrize("text", ["merge_strategy=other", "merge_threshold=0", "nothing=1", "read_only=perhaps", "level_ratio", "level_ratio=x"])
def test_bad_settings(tmp_path, text):
    f = tmp_path / "settings"
    f.write_text(text)
    with pytest.raises(ValueError):
        load(str(f), env={})
