SF_SMALL = "/root/testdata/sf0.001"


def groups_of(n, links):
    """A root for each of n nodes."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]
