"""caselens.operators"""
