"""Sequential replays of traces: page buffers, lock tables. Traces run in parallel, each in its own order."""
