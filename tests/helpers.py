"""Small helpers for literal inputs and expectations."""

import ipaddress


def net(text):
    """A literal block, checked by the standard library."""
    parsed = ipaddress.IPv4Network(text)
    return (int(parsed.network_address), parsed.prefixlen)


NET = "struct<lo:bigint,prefix:int>"


def text_of(value):
    return None if value is None else str(ipaddress.IPv4Network((value["lo"], value["prefix"])))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
