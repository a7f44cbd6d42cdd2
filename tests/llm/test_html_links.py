from docquarry.llm.html_extract import main_text

LONG = "The cat sat on the mat and it was the best of the days that we have ever seen in the town."


def test_link_blocks_inside_an_article_stay():
    for element in ("article", "main"):
        html = f"<body><ul><li><a href=/>Home</a></li></ul><{element}><h2><a href=#t>Title</a></h2><p>{LONG}</p><p><a href=b>{LONG}</a></p><ul><li><a href=c>Reference</a></li></ul><nav><a href=d>Next</a></nav></{element}><p><a href=e>{LONG}</a></p></body>"
        assert main_text(html) == f"Title\n{LONG}\n{LONG}\nReference"


def test_link_blocks_outside_an_article_go():
    assert main_text(f"<body><p><a href=a>{LONG}</a></p><p>{LONG}</p></body>") == LONG
