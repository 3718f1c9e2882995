"""A client that answers from a table instead of a network."""

PAGES = {
    "https://a.example/1": (200, "<p>one</p>", {"ETag": "e1", "Last-Modified": "Mon"}),
    "https://a.example/gone": (404, "not here", {}),
    "https://a.example/robots.txt": (200, "User-agent: *\nDisallow: /private", {}),
    "https://b.example/robots.txt": (404, "nothing", {}),
    "https://c.example/robots.txt": (500, "broken", {}),
}


def answer(url, headers):
    if url.endswith("/boom"):
        raise OSError("no route")
    status, body, given = PAGES[url]
    if headers.get("If-None-Match") and headers["If-None-Match"] == given.get("ETag"):
        return 304, None, given
    return status, body, given
