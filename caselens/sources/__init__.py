"""caselens.sources"""
