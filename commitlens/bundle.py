"""Bundles of tables."""


class Bundle:
    """Tables by name, each made when it is first read, so that a job pays for those only that it uses.

    A table is given as what makes it.  One that is None, or isn't named, isn't there.
    """

    def __init__(self, **made):
        self._made = made

    def __getattr__(self, name):
        if name.startswith("_") or name not in self._made:
            raise AttributeError(name)
        table = self._made[name]()
        if table is None:
            raise AttributeError(name)
        setattr(self, name, table)
        return table
