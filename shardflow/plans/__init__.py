"""How an array gets from one layout to another: classes of moves and tables of transfers."""
