from __future__ import annotations

import datetime as dt

import pytest

FILES = "file_id long, case_id string, path string, content string, level int, scanned_at timestamp_ntz, lang string, line int"
T = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def file_tables(make_tables):
    """php_files of (file_id, project, path, content) rows, with clashing further columns, and the tables beside it."""

    def make(rows, repo=(), refs=(), projects=(), docs=()):
        return make_tables(
            php_files=(FILES, [(i, p, path, c, None, T, "x", 7) for i, p, path, c in rows]),
            repo_files=("project string, path string, content string", list(repo)),
            license_refs=("license_id string, title string, family string, notice string", [(a, b, "f", c) for a, b, c in refs]),
            projects=("project string, ignore_dirs array<string>", list(projects)),
            documents=("doc_id long, text string, lang string, source string, n_chars long, how string", [(*d, None, "x") for d in docs]))

    return make
