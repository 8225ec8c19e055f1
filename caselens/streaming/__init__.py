"""caselens.streaming"""
