"""A parser for the word source: words of a text file on one line."""


def parse(path):
    with open(path.removeprefix("file:")) as f:
        for i, w in enumerate(f.read().split()):
            yield (path, 1, i, w, 50.0 * i, 50.0 * i + 40, 60.0, 70.0, 10.0, "F", True)
