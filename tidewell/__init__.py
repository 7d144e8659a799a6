"""Analytics over owned, nested media records, as lazy DataFrame functions."""
