"""A stand-in for a detector."""


def detector(path, options):
    yield [(0.0, 0.0, 2.0, 4.0, 2, 0.9, None)]
    yield []
    yield [(1.0, 1.0, 2.0, 2.0, None, None, 5)]
