"""Nothing streams: plans run over immutable snapshots, so there are no watermarks, windows or state to keep.

A source that grows is fetched into a new raw directory and built into a new
snapshot, named by its content; see :mod:`lineaframe.sources`.
"""
