"""Running scores over a stream of labelled points."""
