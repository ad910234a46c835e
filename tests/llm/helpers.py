SMALL = "/root/testdata/sf0.001"


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]
