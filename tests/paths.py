"""Paths that tests share (a module of its own: two folders of tests have a conftest)."""

SF = "/root/testdata/sf0.001"
