from canopygrid.functions import bands, coords, geometry, keys, names  # noqa: F401
